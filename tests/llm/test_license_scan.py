from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from sparkvane.llm import license_scan as ls


def words(text):
    return re.sub(r"[\W_]+", " ", (text or "").lower()).split()


def shingles(w):
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}


def plain(rows, templates):
    found = {}
    for i, t in rows:
        w = words(t)
        for name, text in templates.items():
            own = shingles(words(text))
            if not own:
                continue
            half = next(s for s in ls.sizes_for(len(words(text))) if s >= len(words(text)))
            for start in range(0, len(w), half):
                share = len(own & shingles(w[start : start + 2 * half])) / len(own)
                if share >= ls.CONTAINMENT:
                    had = found.get((i, name), (0, start, 0))
                    found[i, name] = max(had[0], share), min(had[1], start), had[2] + 1
    return found


def scanned(df, templates=None):
    return {(r.doc_id, r.license_id): (r.containment, r.first_word, r.windows) for r in ls.scan(df, templates).collect()}


FILLER = "some filler words that say nothing about rights or the like at all and go on for a while "


def test_builtin_templates_in_text(docs, odd_texts):
    rows = [*enumerate(odd_texts)]
    for k, t in enumerate(ls.TEMPLATES.values()):
        rows += [(100 + k, t), (200 + k, FILLER * (k % 3) + t + " " + FILLER), (300 + k, "\n".join(t.upper().split())), (400 + k, " ".join(t.split()[: len(t.split()) // 2]))]
    rows += [(500, FILLER), (501, "All rights are not reserved"), (502, "The license of the software is nobody's business")]
    got = scanned(docs(rows))
    assert got == plain(rows, ls.TEMPLATES)
    for k, name in enumerate(ls.TEMPLATES):
        assert {(100 + k, name), (200 + k, name), (300 + k, name)} <= got.keys()
    assert not [i for i, _ in got if i >= 500 or i < 100]


def test_edited_passages(docs):
    text = ls.TEMPLATES["apache-2.0-terms"].split()
    rows = [(0, " ".join(text[:12] + ["indeed"] + text[12:])), (1, " ".join(text[::2]))]
    assert scanned(docs(rows)) == plain(rows, ls.TEMPLATES) and (0, "apache-2.0-terms") in plain(rows, ls.TEMPLATES)


def test_own_templates(spark, docs):
    own = {"a": "alpha beta gamma delta", "short": "two words", "none": None}
    rows = [(1, "x alpha beta gamma delta y"), (2, "two words"), (None, "alpha beta gamma delta")]
    frame = spark.createDataFrame(list(own.items()), "license_id string, template string")
    assert scanned(docs(rows), frame) == plain(rows, {"a": own["a"]})
    assert scanned(docs(rows), frame.limit(0)) == {}
    assert scanned(docs([])) == {}


@pytest.mark.parametrize("limit", [0, 64 << 20])
def test_many_templates_need_no_broadcast(docs, monkeypatch, limit):
    """Shuffled and broadcast templates, and a bitmap that holds everything, give the same rows."""
    monkeypatch.setattr(ls, "BROADCAST_BYTES", limit)
    rows = [(1, FILLER + ls.TEMPLATES["gpl-3.0-notice"]), (2, FILLER), (3, ls.TEMPLATES["mit-grant"] + FILLER)]
    assert scanned(docs(rows)) == plain(rows, ls.TEMPLATES)
    monkeypatch.setattr(ls, "MIN_BITS", 64)
    monkeypatch.setattr(ls, "MAX_BITS", 64)
    assert scanned(docs(rows)) == plain(rows, ls.TEMPLATES)


def test_bands_find_what_matches(docs):
    """Every occurrence, wherever it stands in its windows."""
    rows = [(i, " ".join(["filler"] * i) + " All rights reserved. " + " ".join(f"w{k}" for k in range(20))) for i in range(40)]
    got = scanned(docs(rows))
    assert {i for i, name in got if name == "all-rights-reserved"} == set(range(40)) and got == plain(rows, ls.TEMPLATES)


@pytest.mark.parametrize("containment", [0.5, 1.0])
def test_other_containments(docs, monkeypatch, containment):
    monkeypatch.setattr(ls, "CONTAINMENT", containment)
    text = ls.TEMPLATES["bsd-grant"].split()
    rows = [(k, FILLER + " ".join(text[:k]) + " " + FILLER) for k in range(3, len(text) + 1)]
    got = {(r.doc_id, r.license_id): (r.containment, r.first_word, r.windows) for r in ls.scan(docs(rows), containment=containment).collect()}
    assert got == plain(rows, ls.TEMPLATES)


def test_templates_of_one_license(spark, docs):
    """Several texts of a license, one of them twice, are one license."""
    a, b = "alpha beta gamma delta epsilon", "one two three four five six seven eight"
    frame = spark.createDataFrame([("x", a), ("x", b), ("x", a), (None, "kappa lambda mu")], "license_id string, template string")
    rows = [(1, f"{FILLER} {a} {FILLER} {b}"), (2, "kappa lambda mu")]
    got = scanned(docs(rows), frame)
    assert got.keys() == {(1, "x"), (2, None)} and got[1, "x"][0] == 1.0


def test_plan_has_no_python(docs):
    plan = ls.scan(docs([(1, "x")]).select("doc_id", F.upper("text").alias("text")))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|InArrow", plan)
    assert re.search(r"transform\(array\(Subquery", plan)  # the Bloom filter is a value of the expression, not a column of rows


@pytest.mark.parametrize("length", [290, 291, 6000])
def test_templates_of_any_length(docs, length):
    """A full license text is found whole, and its halves are not."""
    text = " ".join(f"clause{i * 7919 % 1009} term{i}" for i in range(length // 2 + 1)).split()[:length]
    filler = FILLER.split() * 40
    rows = [(0, " ".join(text)), (1, " ".join(filler + text + filler)), (2, " ".join(text[: length // 2] + filler)), (3, FILLER)]
    rows.append((4, " ".join(filler[:500] + text[:100] + ["edited"] + text[100:])))
    given = docs([(0, "x")]).select(F.lit("long").alias("license_id"), F.lit(" ".join(text)).alias("template"))
    got = scanned(docs(rows), given)
    assert got.keys() == {(0, "long"), (1, "long"), (4, "long")}
    assert got[0, "long"][0] == got[1, "long"][0] == 1.0 and got[4, "long"][0] >= ls.CONTAINMENT
