"""Exact vector search and ranking on Spark."""

from .limits import MAX_BATCH, MAX_DIMENSIONS, MAX_K, MAX_ROWS, Busy, Conflict, InvalidInput
from .operators.corpus import BuildMemory, Corpus, CorpusMemory
from .operators.exclusions import Exclusions
from .operators.ranking import score_batch, top_k
from .operators.search import Measurement, Neighbor, PreparedSearch, ScanConfig, Searcher, SearchInference, collect, configurations, fixed_stride, read_results

__all__ = [
    "MAX_BATCH", "MAX_DIMENSIONS", "MAX_K", "MAX_ROWS", "BuildMemory", "Busy", "Conflict", "Corpus", "CorpusMemory", "Exclusions", "InvalidInput", "Measurement",
    "Neighbor", "PreparedSearch", "ScanConfig", "SearchInference", "Searcher", "collect", "configurations", "fixed_stride", "read_results", "score_batch", "top_k",
]
