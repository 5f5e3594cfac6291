"""Approximate terms against trying all parts."""

import random

import pytest
from pyspark.sql import functions as F

from attesta.operators import approximate as ap
from attesta.operators import names


def brute(texts, term, least):
    return [bool(term) and bool(t) and names.partial(term, t) >= least - 1e-9 for t in texts]


@pytest.mark.parametrize("least", [60.0, 80.0, 88.0, 95.0])
def test_holds_is_brute_force(least):
    r = random.Random(int(least))
    for n in (1, 2, 5, 8, 9, 13, 17, 25, 40):
        term = "".join(r.choice("abcd e") for _ in range(n))
        texts = ["", term, term[1:], "x" + term[:-1], term[: n // 2]]
        for _ in range(40):
            t = list(term)
            for _ in range(r.randrange(0, 2 + n // 6)):
                i = r.randrange(len(t)) if t else 0
                t[i : i + r.randrange(2)] = r.choice(["", "q", "a"])
            texts.append("".join(r.choice("abcdxyz ") for _ in range(r.randrange(30))) + "".join(t) + "".join(r.choice("abcdxyz ") for _ in range(r.randrange(30))))
        texts += ["".join(r.choice("abc") for _ in range(r.randrange(200))) for _ in range(10)]
        assert ap.holds(texts, term, least).tolist() == brute(texts, term, least), (n, term)


def test_terms_longer_than_a_word_of_bits():
    term = "the quick brown fox jumps over the lazy dog and runs away from here to there"
    texts = ["zz " + term.replace("quick", "qick") + " zz", term[:40], "nothing alike"]
    assert ap.holds(texts, term, 88.0).tolist() == brute(texts, term, 88.0)


def test_columns(spark):
    rows = [("firm 12", "we at frm 12 say"), ("firm 12", "none"), (None, "x"), ("firm 7", None), ("é漢", "a é漢 b"), ("firm 12", "y" * 1_000_000 + " firn 12")]
    df = spark.createDataFrame(rows, "name string, text string")
    got = [r[0] for r in df.select(ap.name_held(F.col("name"), F.col("text"))).collect()]
    assert got == [True, False, False, False, True, True]
    held = [sorted(r[0]) for r in df.select(ap.terms_held(F.col("text"), ["firm 12", "none", "nothing"])).collect()]
    assert held == [[], ["none"], [], [], [], []]


def test_company_on_page_reads_whole_texts(spark):
    """T25 against all parts of every text."""
    import __spark_entry__ as entry
    from attesta.plans import employers

    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r["named"] for r in entry.queries()["T25"](spark, sf).collect()}
    rows = [(r["doc_id"], r["company"].lower(), r["text"].lower()) for r in employers.mentioning(spark, sf).collect()]
    for ident, name, text in rows:
        if len(text) < 2500:
            assert got[ident] == (names.partial(name, text) >= 80), ident
        elif name in text:
            assert got[ident]
    assert len(got) == len(rows) and len({*got.values()}) == 2
