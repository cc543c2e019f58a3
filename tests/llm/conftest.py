from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Makes documents from (doc_id, text) pairs, with further columns of clashing names."""

    def make(rows, parts: int = 3):
        full = [(i, t, "en", "src0", None if t is None else len(t), 1, 2.0, "x") for i, t in rows]
        clash = ", version int, score double, n_lines string"
        return spark.createDataFrame(full, SCHEMA + clash).repartition(parts)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Texts that operators must take as they come."""
    return [None, "", " ", "\n\n", "a", "one two three four", "ß é 中文 \U0001d518", "tab\there\r\nnext", "x" * 5000, "word " * 30_000 + "end", "\x00\x1c\x85 ", "▁▁ a  b"]
