"""Training-data operators.

Ten corpus operators (extraction, joins, scans, dedup, scoring, formatting,
token files, tokenizing, media) and the thin queries that apply them.  Nothing
outside this subpackage imports it.
"""
