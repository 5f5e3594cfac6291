"""The lattice search against every path, and what the labels of the given tables allow."""

import itertools
import random

import numpy as np
import pytest

from attesta.llm import toxicity as X


def every_path(token, lm):
    """(score, text) of the best of all paths, by trying each."""
    options = []
    for c in token:
        base = X.plain(c)
        if c in X.GAPS:
            options.append(list(X.GAPS[c]))
        elif len(base) == 1 and "a" <= base <= "z":
            options.append([(c.lower(), -0.05)])
        else:
            own = [(x, -1.0) for x in X.LOOKALIKES.get(c, "")]
            own.append(("", -1.0) if c in X.FILLERS or not c.isalnum() else ("", -6.0))
            if not own[0][0]:
                own.append((c, -8.0))
            options.append(own)
    best = (-np.inf, "")
    for path in itertools.product(*options):
        for repeats in itertools.product((False, True), repeat=len(path)):
            a, b, last, score, out = 26, 26, "", 0.0, ""
            for (x, cost), again in zip(path, repeats):
                if again:
                    if not x or x != last:
                        break
                    score -= 1.5
                elif x:
                    k = X.letter_class(x)
                    score += cost + lm[a, b, k]
                    a, b, last, out = b, k, x, out + x
                else:
                    score += cost
            else:
                best = max(best, (score + lm[a, b, 26], out))
    return best


def test_decode_is_the_best_of_all_paths():
    r = random.Random(4)
    counts = np.random.default_rng(1).integers(0, 40, X.LETTERS**3).astype(float)
    lm = X.language_model(counts)
    for _ in range(150):
        token = "".join(r.choice("abio10$!-3" + X.GAP + X.SEAM) for _ in range(r.randrange(1, 7)))
        assert X.decode(token, lm) == every_path(token, lm)[1], token


INSULTS = ("trash", "pathetic", "idiot", "worthless", "disgusting", "stupid", "clown", "scum", "loser", "moron")


def test_toxic_rows_that_have_an_insult_are_found(spark):
    """Held-out toxic rows that hold one of the ten insults of the invented texts are found; the others are labelled at random."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: (r["held_out"], r["predicted"]) for r in X.score_toxicity(docs, X.train(docs, labels)).collect()}
    rows = docs.join(labels.filter("toxic is not null"), "doc_id").select("doc_id", "text", "toxic").collect()
    has = lambda t: any(w in t.lower() for w in INSULTS)
    held = [(has(r["text"]), r["toxic"], got[r["doc_id"]][1]) for r in rows if got[r["doc_id"]][0]]
    found = [p for h, y, p in held if h and y]
    assert len(found) >= 5 and sum(found) >= 0.9 * len(found)
    wrong = [p for h, y, p in held if not h and not y]
    assert sum(wrong) <= 0.05 * len(wrong)


def test_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    model = X.train(none, spark.createDataFrame([], "doc_id long, toxic int"))
    assert X.score_toxicity(none, model).count() == 0 and model.lexicon == {}


@pytest.mark.parametrize("text", ["", " ", "1d10t " * 30_000])
def test_empty_and_long_texts(spark, text):
    model = X.ToxicModel(X.language_model(np.zeros(X.LETTERS**3)), {"=idiot": 5.0}, (-3.0, 4.0, 0.0, 0.0, 1.0, 0.0))
    got = X.score_toxicity(spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string"), model).collect()
    assert [r["predicted"] for r in got] == [int("1d10t" in text)] * 2
