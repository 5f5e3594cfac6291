"""The tagger on held-out documents: data in notations that the base patterns miss are found, and little else."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_operators import naive_spans

from attesta.llm import pii


@pytest.fixture(scope="module")
def held_out(spark):
    """(model, texts with one datum each, their spans): trained on the even ids of documents, asked of the odd ones."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = pii.train(docs.filter("doc_id % 2 = 0"))
    r, texts, gold = np.random.default_rng(3), [], []
    for row in docs.filter("doc_id % 2 = 1 and length(text) < 6000").orderBy("doc_id").select("text").collect():
        at = int(r.integers(0, len(row["text"]) + 1))
        left, right = row["text"][:at].rsplit(" ", 1)[0], row["text"][at:].split(" ", 1)[-1]
        kind = pii.KINDS[int(r.integers(4))]
        s = pii.rewrite(pii.invented(kind, r), kind, r)
        if pii.base_spans(f"{left[-100:]} {s} {right[:100]}"):
            continue
        texts.append(f"{left} {s} {right}")
        gold.append((len(left) + 1, len(left) + 1 + len(s), kind))
    return model, texts, gold


def test_rewritten_data_are_found_through_the_query(spark, held_out):
    model, texts, gold = held_out
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in pii.span_digest(pii.find_spans(docs, model)).collect()}
    base = [{f"{k}:{a}:{b}" for a, b, k in naive_spans(t)} for t in texts]
    added = [set(found[i].split(",")) - base[i] - {""} for i in range(len(texts))]
    hits = sum(f"{k}:{a}:{b}" in added[i] for i, (a, b, k) in enumerate(gold))
    assert len(gold) > 150 and hits >= 0.9 * len(gold)
    assert hits >= 0.9 * sum(map(len, added))
    for i in range(len(texts)):
        assert base[i] <= set(found[i].split(","))


def test_plain_texts_get_no_spans(held_out):
    model, texts, gold = held_out
    plain = [t[:a] + t[b:] for t, (a, b, _) in zip(texts, gold)]
    more = [pii.added_spans(t, pii.base_spans(t), f) for t, f in zip(plain, pii.model_spans(plain, model))]
    assert sum(map(len, more)) <= 0.01 * len(plain)


def test_a_long_text_is_decoded_in_pieces(held_out):
    model, _, _ = held_out
    filler = " ".join(str(1000 + i % 9000) for i in range(40_000))
    text = f"{filler} write to ann.lee [at] mail [dot] example [dot] org {filler}"
    own = pii.pieces(text)
    assert max(b - a for a, b, _, _ in own) < pii.PIECE and all(x[3] == y[2] for x, y in zip(own, own[1:]))
    base = pii.base_spans(text)
    at = text.index("lee [at]")
    assert any(a <= at < b and k == "email" for a, b, k in pii.added_spans(text, base, pii.model_spans([text], model)[0]))


def test_pieces_cover_what_triggers():
    r = np.random.default_rng(0)
    for _ in range(200):
        text = "".join(r.choice(list("ab 1@."), 600, p=[0.4, 0.4, 0.17, 0.01, 0.01, 0.01]))
        covered = [False] * len(text)
        for _, _, lo, hi in pii.pieces(text):
            for i in range(max(0, lo), min(len(text), hi)):
                assert not covered[i]
                covered[i] = True
        assert all(covered[m.start()] for m in pii.TRIGGER.finditer(text))


def test_no_documents_and_null_ids(spark):
    none = spark.createDataFrame([(None, None), (None, "x 1")], "doc_id long, text string")
    model = pii.train(none)
    assert pii.span_digest(pii.find_spans(none, model)).filter(F.col("spans") != "").count() == 0
