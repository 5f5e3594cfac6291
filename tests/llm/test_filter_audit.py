"""The audit against counting by hand, and its duplicates against comparing all texts."""

from itertools import permutations

import pytest

from attesta.llm import filter_audit as fa
from attesta.llm.common import cut

SCHEMA = "doc_id long, text string, lang string, key string, mask int"


def by_hand(docs, labels):
    """Rows of (part, order, step) counted document by document."""
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    least = {}
    for d, t, _ in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    fails, parts = [], {}
    for d, t, lang in docs:
        x = t or ""
        words = x.encode().split()
        own = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in x) > 10 * len(x),
            "D": any(c in "#$%&*|" for c in x),
            "E": d is not None and d > least[x],
        }
        parts.setdefault(lang or "", []).append((own, d in good, d in toxic))
    out = {}
    for part, rows in parts.items():
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = list(rows)
            for step, f in enumerate(order, 1):
                removed = [r for r in left if r[0][f]]
                left = [r for r in left if not r[0][f]]
                shapley[f] += len(removed)
                before = order[: step - 1]
                redundant = sum(r[0][f] and any(r[0][g] for g in before) for r in rows)
                alone = sum(r[0][f] and sum(r[0].values()) == 1 for r in rows)
                out[part, order, step] = [len(left), len(removed), redundant, alone, sum(r[1] for r in removed), sum(r[2] for r in removed)]
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                out[part, order, step].append(shapley[f])
    return out


def told(df):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in df.collect()}


def test_against_counting_by_hand(spark):
    many = " ".join(f"w{i}" for i in range(120))
    long = "lorem " * 400_000
    texts = [many, many, many + "!", "AB " * 50, "", None, "x # y", many.upper(), long, long, long[:-1], "é" * 300, "é" * 299 + "è", "e" * 300, many, "a b " * 80]
    docs = [(i, t, ("en", "de", None, "")[i % 4]) for i, t in enumerate(texts)]
    docs += [(None, many, "en"), (None, many, "en"), (0, many, "de"), (0, "other " * 3, "en"), (4, many, "en"), (4, many, "en")]
    labels = [(0, 1, 0), (1, 1, 1), (1, 0, 0), (3, None, 1), (8, 1, None), (None, 1, 1), (99, 1, 1)]
    frame = spark.createDataFrame([(*d, "k", 7) for d in docs], "doc_id long, text string, lang string, key string, mask int")
    got = told(fa.audit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert got == by_hand(docs, labels)


@pytest.mark.parametrize("bits", [1 << 27, 1 << 15])
def test_duplicates_of_texts_that_agree_in_all_but_one_block(spark, bits):
    """Classes that only a late block splits, and a bitmap so small that other texts pass it."""
    base = "0123456789abcdef" * 2000
    texts = [base, base[:-1] + "X", base, "Y" + base[1:], base[:300] + "Z" + base[301:], base[:-1] + "X", *(f"single {i}" for i in range(60)), "single 7"]
    docs = spark.createDataFrame([(100 - i, t, "en", "k", 0) for i, t in enumerate(texts)], SCHEMA)
    rows = cut(fa.described(docs), "t")
    least = {}
    for i, t in enumerate(texts):
        least[t] = min(100 - i, least.get(t, 1000))
    assert sorted(r["id"] for r in fa.duplicates(docs, rows, bits=bits).collect()) == sorted(100 - i for i, t in enumerate(texts) if 100 - i > least[t])


def test_one_text_in_a_third_of_the_rows_and_empty_tables(spark):
    docs = [(i, "the same" if i % 3 == 0 else f"own {i}", "en") for i in range(1500)]
    frame = spark.createDataFrame([(*d, "k", 0) for d in docs], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = told(fa.audit(frame, labels))
    assert got == by_hand(docs, [])
    assert fa.audit(frame.limit(0), labels).collect() == []
