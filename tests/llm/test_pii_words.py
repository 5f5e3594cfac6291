"""Data with names and hosts that are words, in sentences, among numbers and at line ends; none of these lists is used in training."""

import random

import pytest

from attesta.llm import pii

FIRST = "julia maria peter thomas elena lucas sophie martin clara oliver nina hugo david laura simon".split()
LAST = "young dubois keller novak brown garcia meyer rossi walker fischer lopez bernard king olsen".split()
HOSTS = "uni.edu mail.example.org post.de webmail.fr acme.com data-lab.net city.gov research.example.com shop.es".split()
BEFORE = ["Please write to", "Contact:", "You may reach me at", "for questions,", "\nauthor", "see 2014 2015 2016", "Schreiben Sie an", "1002 1003 1004 1005", "tel/mail"]
AFTER = ["as soon as you can.", "\nThank you", "or come by.", ", she said", "1006 1007 1008", "bitte.", ""]


def email(r):
    user, host = f"{r.choice(FIRST)}{r.choice(['.', '_', ''])}{r.choice(LAST)}", r.choice(HOSTS)
    at, dot = r.choice([(" at ", " dot "), ("[at]", "."), ("(at)", "(dot)"), (" [at] ", " [dot] "), (" AT ", " DOT "), ("[at]", "[dot]"), (" (at) ", " (dot) ")])
    return user + at + host.replace(".", dot)


def phone(r):
    a, b, c = (f"{r.randrange(10**k):0{k}}" for k in (3, 3, 4))
    return r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"1-{a}-{b}-{c}"])


def ip(r):
    return r.choice(["[.]", "(.)", "[dot]", " dot "]).join(str(r.randrange(256)) for _ in range(4))


def card(r):
    while True:
        d = str(r.randrange(4 * 10**15, 6 * 10**15))
        if pii.luhn(d):
            return r.choice([".", "/", "_"]).join(d[i : i + 4] for i in range(0, 16, 4))


@pytest.fixture(scope="module")
def model(spark):
    return pii.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


@pytest.mark.parametrize("kind,make", [("email", email), ("phone", phone), ("ip", ip), ("card", card)])
def test_recall_and_precision_of_a_kind(model, kind, make):
    r = random.Random(5)
    texts, gold = [], []
    while len(texts) < 200:
        s, before = make(r), r.choice(BEFORE)
        text = f"{before} {s} {r.choice(AFTER)}"
        if pii.base_spans(text):
            continue
        texts.append(text)
        gold.append((len(before) + 1, len(before) + 1 + len(s), kind))
    added = [pii.added_spans(t, pii.base_spans(t), f) for t, f in zip(texts, pii.model_spans(texts, model))]
    hits = sum(g in a for g, a in zip(gold, added))
    assert hits >= 0.9 * len(gold), (hits, [(t, a) for t, g, a in zip(texts, gold, added) if g not in a][:6])
    assert hits >= 0.9 * sum(map(len, added)), (hits, [(t, a) for t, g, a in zip(texts, gold, added) if a and a != [g]][:6])


def test_rows_of_numbers_are_nothing(model):
    texts = [" ".join(str(1000 + 37 * k + i) for i in range(60)) for k in range(40)]
    bare = [[s for s in pii.added_spans(t, pii.base_spans(t), f)] for t, f in zip(texts, pii.model_spans(texts, model))]
    assert not [b for b in bare if b][1:], bare
