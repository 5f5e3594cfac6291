"""Signs of generated text: eight signals with a verdict, and nine yes-or-no features for a trained gate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta.functions.text import words
from attesta.operators.injection import contains_any
from attesta.operators.review import variation

# Weights and limits of the signals.
WEIGHTS = {"no_specifics": 2.0, "markers": 2.0, "uniform_bullets": 1.5, "even_sentences": 1.5, "same_openings": 1.0, "triads": 1.0, "too_clean": 1.0, "dashes": 0.5}
CAP, LOW, HIGH, LEAST_CHARS, FIRST_DAY = 6.0, 0.35, 0.60, 250, "2022-01-01"
# English word lists; other languages are parameters.
MARKERS = ("in today's world", "important to note", "plays a key role", "wide range of", "in conclusion", "synergy", "rapidly evolving", "unique opportunity")
HUMAN = ("lol", "imho", "btw", "gonna", "wtf", "omg")
COLLOQUIAL = ("!!", "...", "lol", "btw", "gonna", "kinda", "by the way")
PROS_CONS = ("pros", "cons", "advantages", "drawbacks")
SPECIFIC = r"(?i)[0-9]|python|java|sql|kafka|docker|excel|jira|linux"
TRIAD = r"(?i)[a-z]+\s*,\s*[a-z\s]{2,30},\s*[a-z\s]{2,30}\s+and\s+[a-z]+"


def most_equal(values: Column) -> Column:
    """How often the most frequent of an array's values is in it: one pass over the sorted array."""
    start = F.struct(F.lit("").alias("v"), F.lit(0).alias("n"), F.lit(0).alias("best"))

    def step(s: Column, x: Column) -> Column:
        n = F.when(s["v"] == x, s["n"] + 1).otherwise(F.lit(1))
        return F.struct(x.alias("v"), n.alias("n"), F.greatest(s["best"], n).alias("best"))

    return F.aggregate(F.array_sort(values), start, step)["best"]


def _trimmed(parts: Column, least: int = 1) -> Column:
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: F.length(s) >= least)


def first_word(text: Column) -> Column:
    return F.lower(F.regexp_extract(text, r"[A-Za-z0-9]+", 0))


def parts(text: Column) -> dict[str, Column]:
    """What the signals are read from; select these first, so that each is computed once."""
    return {
        "sentences": _trimmed(F.regexp_extract_all(text, F.lit(r"[^.!?\n]+"), F.lit(0)), 2),
        "bullets": _trimmed(F.regexp_extract_all(text, F.lit(r"(?m)^\s*(?:[-*•]|[0-9]+[.)])\s+(.+)$"), F.lit(1))),
        "low": F.lower(text),
    }


def signals(text: Column, review: bool = True, markers: tuple[str, ...] = MARKERS, human: tuple[str, ...] = HUMAN) -> dict[str, Column]:
    """Code to whether it applies, from text and the columns of `parts`; too_clean is asked of reviews only."""
    low, sentences, bullets = F.col("low"), F.col("sentences"), F.col("bullets")
    per = F.greatest(F.length(text) / 1000.0, F.lit(0.001))
    kinds = F.transform(bullets, lambda b: F.regexp_extract(first_word(b), r"(ing|ed|ion|ness|ment|ly|s)$", 1))
    openings = F.filter(F.transform(sentences, first_word), lambda w: w != "")
    said = sum((F.contains(low, F.lit(m)).cast("int") for m in markers), F.lit(0))
    lengths = lambda x: F.transform(x, lambda s: F.length(s).cast("double"))
    enough = F.size(sentences) >= 4
    return {
        "no_specifics": F.regexp_count(text, F.lit(SPECIFIC)) / per < 1.0,
        "markers": said / per >= 2.0,
        "uniform_bullets": (F.size(bullets) >= 4) & (F.round(variation(lengths(bullets)), 9) <= 0.15) & (most_equal(kinds) / F.size(bullets) >= 0.8),
        "even_sentences": enough & (F.round(variation(lengths(sentences)), 9) < 0.25),
        "same_openings": enough & (most_equal(openings) >= 3),
        "triads": F.regexp_count(text, F.lit(TRIAD)) >= 2,
        "too_clean": F.lit(review) & ~(contains_any(low, human) | text.rlike(r"\.{3,}|!{2,}|\?{2,}|\b[A-Z]{4,}\b")),
        "dashes": F.regexp_count(text, F.lit("[—–]")) / per >= 4.0,
    }


def codes(signs: dict[str, Column]) -> Column:
    """The codes that apply, in the order of the signals."""
    return F.array_compact(F.array(*(F.when(on, F.lit(c)) for c, on in signs.items())))


def verdict(found: Column, text: Column, day: Column) -> tuple[Column, Column]:
    """(score, label) of a row's codes; short texts, and those dated before generated text was common, are skipped."""
    total = sum((F.when(F.array_contains(found, c), F.lit(w)).otherwise(F.lit(0.0)) for c, w in WEIGHTS.items()), F.lit(0.0))
    score = F.round(F.least(F.lit(1.0), total / CAP), 2)
    skip = (F.length(F.trim(text)) < LEAST_CHARS) | F.coalesce(day < F.lit(FIRST_DAY).cast("date"), F.lit(False))
    label = F.when(skip, "skip").when(score >= HIGH, "likely").when(score >= LOW, "suspect").otherwise("human")
    return F.when(skip, F.lit(0.0)).otherwise(score), label


FEATURES = ("filler", "no_colloquial", "no_number", "no_name", "even", "no_short", "pros_cons", "typography", "no_repeats")


def feature_parts(text: Column) -> dict[str, Column]:
    """What the features are read from; select these first."""
    body = F.trim(text)
    pieces = _trimmed(F.split(body, r"[.!?…]+"))
    return {
        "body": body,
        "sizes": F.transform(pieces, lambda s: F.regexp_count(s, F.lit(r"[A-Za-z]+")).cast("double")),
        "tokens": F.regexp_extract_all(F.lower(body), F.lit(r"[a-z]+"), F.lit(0)),
    }


def features(least: int = 120) -> dict[str, Column]:
    """Nine features, 0 or 1, from the columns of `feature_parts`; of a text of fewer than `least` characters all 0."""
    body, sizes, w = F.col("body"), F.col("sizes"), F.col("tokens")
    low, counted = F.lower(body), F.filter(sizes, lambda n: n > 0)
    said = lambda phrases: sum((F.contains(low, F.lit(p)).cast("int") for p in phrases), F.lit(0))
    on = {
        "filler": said(MARKERS) >= 2,
        "no_colloquial": ~contains_any(low, COLLOQUIAL),
        "no_number": ~body.rlike("[0-9]"),
        "no_name": ~body.rlike(r"[a-z,] [A-Z][a-z]{2,}"),
        "even": (F.size(counted) >= 3) & (F.round(variation(counted), 9) <= 0.25),
        "no_short": (F.size(sizes) >= 4) & F.forall(sizes, lambda n: n >= 6),
        "pros_cons": said(PROS_CONS) >= 2,
        "typography": F.contains(body, F.lit("—")),
        "no_repeats": (F.size(w) >= 60) & (F.size(F.array_distinct(w)) / F.size(w) >= 0.75),
    }
    return {k: ((F.length(body) >= least) & c).cast("int") for k, c in on.items()}


def type_token_ratio(text: Column) -> Column:
    w = words(text)
    return F.when(F.size(w) > 0, F.size(F.array_distinct(w)) / F.size(w)).otherwise(F.lit(0.0))
