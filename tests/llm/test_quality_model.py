"""The compiled score against the rules applied by hand, statistics against Python, and odd inputs."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from attesta.llm import quality_rules as Q

TEXTS = ["", " ", "one", "Hello World. Hello World!! a | b|c 123 45", "SHOUT!! SHOUT!! now now now", "naïve café — ok? Ünï", "x\ny\n\nz " * 50, "word " * 20_000]


def by_hand(t):
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", t) if w]
    letter, upper = sum(c.isalpha() for c in t), sum(c.isupper() for c in t)
    return {"chars": math.log1p(len(t)), "words": math.log1p(len(words)), "letter_share": letter / len(t) if t else 0.0, "upper_share": upper / len(t) if t else 0.0, "digit_share": sum(c in "0123456789" for c in t) / len(t) if t else 0.0, "shouts": math.log1p(t.count("!!")), "bars": math.log1p(t.count("|")), "stop_share": sum(c in ".!?" for c in t) / len(words) if words else 0.0, "words_per_line": len(words) / (t.count("\n") + 1), "distinct_share": len(set(words)) / len(words) if words else 0.0}


def test_statistics_are_those_of_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, text string")
    got = df.select("i", *(c.alias(k) for k, c in Q.statistics(F.col("text")).items())).orderBy("i").collect()
    for r, t in zip(got, TEXTS):
        for k, v in by_hand(t).items():
            assert r[k] == pytest.approx(v, abs=1e-9), (k, t[:30])


def test_column_is_the_sum_of_the_rules(spark):
    rules = ((((("words", True, 1.0), ("bars", False, 0.5))), 1.5), (((("chars", False, 3.0),)), -2.0))
    model = Q.RuleModel(rules, 0.25)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in Q.score_quality(df, model).collect()}
    for i, t in enumerate(TEXTS):
        s = by_hand(t)
        z = 0.25 + 1.5 * (s["words"] > 1.0 and s["bars"] <= 0.5) - 2.0 * (s["chars"] <= 3.0)
        assert got[i] == pytest.approx(1 / (1 + math.exp(-z)))
    kept = {r["doc_id"] for r in Q.keep_good(df, model).collect()}
    assert kept == {i for i in got if got[i] >= 0.5}


def test_fitted_rules_cover_what_they_say():
    r = np.random.default_rng(0)
    x = r.random((400, 3))
    y = (x[:, 0] > 0.5).astype(float)
    model = Q.fit(x, y, ["a", "b", "c"])
    z = np.full(400, model.intercept)
    for rule, w in model.rules:
        on = np.ones(400, bool)
        for name, above, t in rule:
            v = x[:, "abc".index(name)]
            on &= (v > t) if above else (v <= t)
        z += w * on
    assert ((z > 0) == (y == 1)).mean() > 0.97


def test_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    model = Q.train(none, spark.createDataFrame([], "doc_id long, quality int"))
    assert Q.score_quality(none, model).count() == 0 and Q.keep_good(none, model).count() == 0
