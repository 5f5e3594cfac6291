"""Reviews of employers: patterns, sections, areas, legitimacy, signs of bought reviews, and a risk level.

Word lists are English and are parameters of the rules; every function is a column expression or a frame of them.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.operators.history import bursts
from attesta.operators.injection import contains_any
from attesta.streaming.events import written

# (code, polarity, weight, needles)
PATTERNS = [
    ("late_salary", "red", 5, ("salary was late", "never pay on time", "pay late")),
    ("shouting", "red", 3, ("shouted", "boss was rude")),
    ("overtime", "red", 3, ("overtime", "long hours")),
    ("fired", "red", 2, ("was fired",)),
    ("fair_pay", "green", 3, ("salary came on time", "good pay")),
    ("friendly", "green", 2, ("friendly team", "help each other", "toxic")),
]
NEGATIONS = ("not ", "no ", "never ")
PLUS = {"work_words": 2.0, "first_person": 1.5, "pros_cons": 1.5, "has_rating": 0.5, "has_date": 0.5}
MINUS = {"customer": 5.0, "boilerplate": 5.0, "employer_reply": 5.0, "navigation": 5.0, "reader_address": 1.5, "promo": 1.5, "no_work_context": 2.0}
HARD = ("customer", "boilerplate", "employer_reply", "navigation")
WORK = ("worked", "manager", "salary", "colleague", "fired", "boss", "office", "overtime", "team")
FIRST = ("i worked", "i was", "my ", "i left")
CUSTOMER = ("deliver", "order within", "buy now", "refund")
REPLY = ("thank you for your feedback", "we are sorry to hear")
READER = ("join this company", "recommend to all", "buy now")
PROMO = r"https?://|\+[0-9][0-9 ()-]{8,}|[$€][0-9]"
AREAS = {"sales": (("manager", "boss"), ("order", "deliver", "shop")), "engineering": (("engineer", "developer"), ("release", "overtime")), "office": (("hr",), ("office", "colleagues", "salary"))}
CLICHES = ("recommend to all", "best company", "join this company", "plays a key role", "synergy")
SIGNALS = {"dup_other_company": 5.0, "dup_same_company": 3.0, "paraphrase": 2.0, "cliches": 2.0, "ad_tail": 2.0, "impersonal": 2.0, "rating_mismatch": 2.0, "burst": 2.0, "ai_text": 2.0, "no_specifics": 1.0, "empty_cons": 1.0, "short_top": 1.0, "uniform_length": 1.0, "low_trust_site": 0.5, "llm_ad": 0.5}
TEXT_SIGNALS = ("dup_other_company", "ai_text", "cliches", "impersonal", "ad_tail", "llm_ad")
CROWD = ("uniform_length", "dup_same_company", "burst", "paraphrase")


def _times(text: Column, needle: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / F.lit(len(needle))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is evaluated once a row, however often use names it and wherever a filter is pushed."""
    return F.transform(F.array(value), use)[0]


def matched(low: Column, needles: tuple[str, ...], skip_negated: bool) -> Column:
    """Whether a text has a needle; of a green pattern, one that no negation stands before."""
    if not skip_negated:
        return contains_any(low, needles)
    # most texts lack the needle, and are not counted through
    free = lambda n: F.contains(low, F.lit(n)) & (_times(low, n) > sum((_times(low, f"{x}{n}") for x in NEGATIONS), F.lit(0.0)))
    out = free(needles[0])
    for n in needles[1:]:
        out = out | free(n)
    return out


def pattern_codes(text: Column, rules=PATTERNS) -> Column:
    """Codes of the patterns of a text, in the order of the rules."""
    found = lambda low: F.array_compact(F.array(*(F.when(matched(low, needles, polarity == "green"), F.lit(code)) for code, polarity, _, needles in rules)))
    return once(F.lower(text), found)


def pattern_summary(rows: DataFrame, owner: str, key: str, text: str, rules=PATTERNS, quotes: int = 3) -> DataFrame:
    """(owner, code, polarity, weight, hits, quotes): rows, not occurrences; the first `quotes` by key, around their needle."""
    def found(t: Column) -> Column:
        low = t["low"]
        out = []
        for code, polarity, weight, needles in rules:
            first = F.array_min(F.array_compact(F.array(*(F.when(F.contains(low, F.lit(n)), F.locate(n, low)) for n in needles))))
            quote = F.substring(t["text"], F.greatest(first - 20, F.lit(1)), F.lit(60))
            out.append(F.when(matched(low, needles, polarity == "green"), F.struct(F.lit(code).alias("code"), F.lit(polarity).alias("polarity"), F.lit(weight).alias("weight"), quote.alias("quote"))))
        return F.array_compact(F.array(*out))

    def read(x: Column) -> Column:
        return once(x, lambda t: once(F.struct(t.alias("text"), F.lower(t).alias("low")), found))

    out = rows.select(owner, key, F.explode(read(F.col(text))).alias("s")).select(owner, key, "s.*")
    place = F.row_number().over(Window.partitionBy(owner, "code").orderBy(key))
    ranked = out.withColumn("place", place)
    return ranked.groupBy(owner, "code", "polarity", "weight").agg(F.count(F.lit(1)).alias("hits"), F.transform(F.sort_array(F.collect_list(F.when(F.col("place") <= quotes, F.struct("place", "quote")))), lambda q: q["quote"]).alias("quotes"))


def section(text: Column, start: str, stop: str) -> Column:
    """The first line that isn't blank after the word `start`, up to the word `stop`; empty without one."""
    tail = F.regexp_extract(text, rf"(?is){start}:[\s;.,-]*(.*?)(?:{stop}:|\z)", 1)
    return F.trim(F.regexp_extract(tail, r"^\s*([^\n]+)", 1))


def area(text: Column, head: Column, areas=AREAS, least: float = 2, margin: float = 1) -> tuple[Column, Column]:
    """(area, score): three points for a role in the head, two in the text, one for a marker; unsure ones are unknown."""
    body, top = (F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(x), r"[^0-9a-z]+", " "))) for x in (text, head))
    hits = lambda where, words: sum((F.contains(where, F.lit(f" {w}")).cast("int") for w in words), F.lit(0))

    def ranked(t: Column) -> Column:
        body, top = t["body"], t["top"]
        return F.array_sort(F.array(*(F.struct((-(3 * hits(top, roles) + 2 * hits(body, roles) + hits(body, marks))).alias("s"), F.lit(name).alias("a")) for name, (roles, marks) in areas.items())))

    def chosen(r: Column) -> Column:
        best, second = -r[0]["s"], -r[1]["s"]
        return F.struct(F.when((best >= least) & (best - second >= margin), r[0]["a"]).otherwise(F.lit("unknown")).alias("a"), best.alias("s"))

    found = once(once(F.struct(body.alias("body"), top.alias("top")), ranked), chosen)
    return found["a"], found["s"]


def legitimacy_signs(text: Column, rating: Column, dated: Column, pros: Column, cons: Column) -> Column:
    """What a review's own text and fields say for and against it, as a struct of booleans; see legitimacy."""
    marks = sum((_times(text, m) for m in (">", "|")), F.lit(0.0))
    stops = sum((_times(text, m) for m in ".!?"), F.lit(0.0))
    words = {"work_words": WORK, "first_person": FIRST, "customer": CUSTOMER, "employer_reply": REPLY, "reader_address": READER}
    said = once(F.lower(text), lambda low: F.struct(*(contains_any(low, w).alias(c) for c, w in words.items())))
    fields = {"pros_cons": (pros != "") & (cons != ""), "has_rating": rating.isNotNull(), "has_date": dated.isNotNull(), "promo": text.rlike(PROMO), "navigation": (marks > 5) & (stops < 3)}
    return F.struct(said.alias("said"), *(x.alias(c) for c, x in fields.items()))


def legitimacy(signs: Column, boilerplate: Column) -> tuple[Column, Column, Column]:
    """(score, reasons, ok) of a review's signs: weights of what speaks for it less those against it; a hard reason alone refuses it."""
    work = signs["said"]["work_words"]
    said = {c: signs["said"][c] for c in ("first_person", "employer_reply", "reader_address")}
    plus = {"work_words": work, "first_person": said["first_person"], **{c: signs[c] for c in ("pros_cons", "has_rating", "has_date")}}
    minus = {"no_work_context": ~work, "customer": signs["said"]["customer"] & ~work, "employer_reply": said["employer_reply"], "reader_address": said["reader_address"], "promo": signs["promo"], "navigation": signs["navigation"], "boilerplate": boilerplate}
    reasons = F.array_compact(F.array(*(F.when(on, F.lit(c)) for c, on in minus.items())))
    score = sum((F.when(on, F.lit(PLUS[c])).otherwise(F.lit(0.0)) for c, on in plus.items()), F.lit(0.0)) - sum((F.when(on, F.lit(MINUS[c])).otherwise(F.lit(0.0)) for c, on in minus.items()), F.lit(0.0))
    return F.round(score, 2), reasons, ~F.arrays_overlap(reasons, F.array(*map(F.lit, HARD))) & (score >= 1.0)


def item_signals(rows: DataFrame, trust: dict[str, float]) -> DataFrame:
    """rows (company, doc_id, site, text, rating, cons, pros, dated_at, h, codes) with `signals`: those of single reviews, and those of their company's.

    h: the digest of the normal form; codes: the signals of generated text. Signals that more than half of a company's
    eight or more reviews have are dropped: they tell nothing apart. Texts are read once: what they tell is written, and
    only that is grouped and joined.
    """
    low, n = F.col("low"), F.length("text")
    red = contains_any(low, [x for _, polarity, _, needles in PATTERNS if polarity == "red" for x in needles])
    praise = contains_any(low, [x for _, polarity, _, needles in PATTERNS if polarity == "green" for x in needles])
    cliches = sum((F.contains(low, F.lit(c)).cast("int") for c in CLICHES), F.lit(0))
    low_trust = F.coalesce(F.create_map(*(F.lit(x) for kv in trust.items() for x in kv))[F.col("site")], F.lit(1.0)) < 0.8
    single = {
        "no_specifics": ~F.col("text").rlike("[0-9]") & ~contains_any(low, WORK),
        "cliches": (n <= 700) & (cliches >= 2),
        "empty_cons": F.lower(F.trim("cons")).isin("no", "none", "nothing"),
        "short_top": (F.col("rating") >= 4.5) & (n < 200),
        "rating_mismatch": ((F.col("rating") >= 4.5) & red) | ((F.col("rating") <= 2.0) & ~red & praise),
        "ad_tail": low.rlike(r"buy now|https?://"),
        "impersonal": contains_any(low, ("plays a key role", "wide range of opportunities")),
        "low_trust_site": low_trust,
        "ai_text": F.size("codes") >= 3,
    }
    rows = written(rows.withColumn("low", F.lower("text")).select("company", "doc_id", "site", "dated_at", "h", n.alias("size"), *(F.coalesce(c, F.lit(False)).alias(k) for k, c in single.items())))
    # A text that another company has: the digest's companies, counted by their least and greatest name.
    owners = rows.groupBy("h").agg(F.min("company").alias("lo"), F.max("company").alias("hi"))
    twins = rows.groupBy("company", "h").agg(F.count(F.lit(1)).alias("same"))
    per = rows.groupBy("company").agg(F.count(F.lit(1)).alias("total"), (F.min("site") == F.max("site")).alias("one_site"))
    flat = even_lengths(rows.filter("size >= 200").select("company", "doc_id", "size"))
    hot = bursts(rows.filter("dated_at is not null").select("company", "doc_id", F.datediff("dated_at", F.lit("2000-01-01").cast("date")).alias("day")), "company", "day").select("doc_id", "hot")
    every = rows.join(owners, "h").join(twins, ["company", "h"]).join(per, "company").join(hot, "doc_id", "left").join(flat, "doc_id", "left")
    on = {
        **{k: F.col(k) for k in single},
        "low_trust_site": F.col("one_site") & F.col("low_trust_site"),
        "dup_other_company": F.col("lo") != F.col("hi"),
        "dup_same_company": (F.col("lo") == F.col("hi")) & (F.col("same") > 1),
        "burst": F.coalesce("hot", F.lit(False)),
        "uniform_length": F.coalesce("even", F.lit(False)),
    }
    flags = every.select("company", "doc_id", "total", *(F.coalesce(c, F.lit(False)).alias(k) for k, c in on.items()))
    crowd = [c for c in CROWD if c in on]
    many = flags.groupBy("company").agg(*(((F.first("total") >= 8) & (F.avg(F.col(c).cast("int")) > 0.5)).alias(f"many_{c}") for c in crowd))
    kept = flags.join(many, "company")
    codes = F.array_compact(F.array(*(F.when(F.col(c) & ~F.col(f"many_{c}") if c in crowd else F.col(c), F.lit(c)) for c in on)))
    return kept.select("company", "doc_id", codes.alias("signals"))


def even_lengths(rows: DataFrame, spread: float = 0.1, least: int = 3) -> DataFrame:
    """(doc_id, even) of rows (company, doc_id, size): whether at least `least` reviews, from some review's length down by `spread`, hold it.

    Lengths are counted first; a share of a length is an interval of its logarithm, here in billionths.
    """
    reach = math.ceil(-math.log(1 - spread) * 1e9) + 2
    sizes = rows.groupBy("company", "size").agg(F.count(F.lit(1)).alias("n")).withColumn("at", F.floor(F.log("size") * 1e9))
    w = Window.partitionBy("company").orderBy("at")
    hot = sizes.withColumn("group", (F.sum("n").over(w.rangeBetween(-reach, 0)) >= least).cast("int"))
    hot = hot.withColumn("even", F.max("group").over(w.rangeBetween(0, reach)) == 1)
    return rows.join(hot.select("company", "size", "even"), ["company", "size"]).select("doc_id", "even")


def fake_verdict(signals: Column) -> tuple[Column, Column]:
    """(score, label) of a review's signals; without one about its own text it is at most suspect."""
    total = sum((F.when(F.array_contains(signals, c), F.lit(w)).otherwise(F.lit(0.0)) for c, w in SIGNALS.items()), F.lit(0.0))
    score = F.round(F.least(F.lit(1.0), total / 6.0), 2)
    own = F.arrays_overlap(signals, F.array(*map(F.lit, TEXT_SIGNALS)))
    label = F.when((score >= 0.6) & own, "fake").when(score >= 0.35, "suspect").otherwise("clean")
    return F.when((score >= 0.6) & ~own, F.lit(0.6)).otherwise(score), label


def risk(n: Column, flagged: Column, clean_weight: Column, heavy: Column, red: Column, green: Column, negative: Column, rating: Column) -> Column:
    """The traffic light of an employer: bought reviews first, then too few, then patterns, negatives and the mean rating."""
    bad = heavy | (negative >= 0.6) | F.coalesce(rating <= 2.5, F.lit(False))
    warn = red | (negative >= 0.3) | F.coalesce(rating < 3.8, F.lit(False))
    good = green | F.coalesce(rating >= 4.0, F.lit(False))
    return F.when(n == 0, "unknown").when(flagged, "red").when(clean_weight < 3, "thin").when(bad, "red").when(warn, "yellow").when(good, "green").otherwise("yellow")
