"""Scores of records against profiles, claims against history, contacts of a text, and evidence of employers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Default weights of the criteria.
WEIGHTS = {"salary": 20, "skills": 55, "nice": 10, "remote": 10, "experience": 5, "market": 0, "title": 15}


def stopped(tokens: Column, text: Column, words: Column) -> Column:
    """Whether a text has a stop word: a phrase as it stands, a word by its stem (without its last letter from five letters on)."""
    stem = lambda w: F.when(F.length(w) >= 5, F.substring(w, 1, F.length(w) - 1)).otherwise(w)
    return F.exists(words, lambda w: F.when(F.contains(w, F.lit(" ")), F.contains(text, w)).otherwise(F.exists(tokens, lambda t: t.startswith(stem(w)))))


def share(words: Column, held: Column) -> Column:
    """The share of words that are among those held; 0 of none."""
    return F.when(F.size(words) > 0, F.size(F.filter(words, lambda w: F.array_contains(held, w))) / F.size(words)).otherwise(F.lit(0.0))


def points(held: Column, named: Column, net: Column, remote: Column, experience: Column, market: Column, skills: Column, nice: Column, wanted: Column, min_net: Column, experience_ok: Column, weights: Mapping[str, Column]) -> dict[str, Column]:
    """What each of the seven criteria gives. held, named: the terms that the record's text and its title hold, see approximate.terms_held."""
    w = weights
    pay = F.when(net.isNull(), 0.4).when((min_net > 0) & (net < min_net), 0.6).otherwise(1.0)
    known = (F.size(experience_ok) > 0) & (F.coalesce(experience, F.lit("")) != "")
    return {
        "salary": w["salary"] * pay,
        "skills": w["skills"] * share(skills, held),
        "nice": w["nice"] * share(nice, held),
        "remote": F.when(remote, w["remote"]).otherwise(F.lit(0.0)),
        "experience": w["experience"] * F.when(~known, 0.5).when(F.array_contains(experience_ok, experience), 1.0).otherwise(0.0),
        "market": w["market"] * F.coalesce(market, F.lit(0.0)),
        "title": F.when(F.arrays_overlap(named, wanted), w["title"]).otherwise(F.lit(0.0)),
    }


def ceiling(title: Column, named: Column, wanted: Column, weights: Mapping[str, Column]) -> Column:
    """The most that a record can still reach: all weights, less the title's where the title is known and says none of the wanted words."""
    rest = sum((w for k, w in weights.items() if k != "title"), F.lit(0.0))
    may = (F.size(wanted) == 0) | (title == "") | F.arrays_overlap(named, wanted)
    return F.round(F.least(rest + F.when(may, weights["title"]).otherwise(F.lit(0.0)), F.lit(100.0)), 1)


# (claim, patterns)
CLAIMS = [("stable_team", (r"stable team", r"close-knit team")), ("no_overtime", (r"no overtime",)), ("white_salary", (r"official salary",)), ("growth", (r"career growth",))]
OVERTIME = (r"fast pace", r"weekend", r"irregular hours")


def claims_of(text: Column, window: int = 45) -> Column:
    """Array of (kind, quote): each claim once, by the first of its patterns that is found."""
    found = []
    for kind, patterns in CLAIMS:
        at = F.coalesce(*(F.nullif(F.regexp_instr(text, F.lit(f"(?i){p}")), F.lit(0)) for p in patterns))
        start = F.greatest(at - window, F.lit(1))
        found.append(F.when(at.isNotNull(), F.struct(F.lit(kind).alias("kind"), F.trim(F.regexp_replace(F.substring(text, start, at - start + F.lit(2 * window)), r"\s+", " ")).alias("quote"))))
    return F.array_compact(F.array(*found))


def verdict(kind: Column, text: Column, low: Column, high: Column, days: Column, published: Column, salary_changes: Column) -> tuple[Column, Column]:
    """(verdict, confidence) of a claim against the record's history, its text and its pay."""
    hist = F.when(days >= 60, "high").when(days >= 14, "middle").otherwise("low")
    hint = text.rlike("(?i)" + "|".join(OVERTIME))
    stable = F.when(days < 14, "no_data").when(published >= 3, "not_supported").otherwise("supported")
    pay = F.when(low.isNull() & high.isNull(), "not_supported").when(salary_changes > 0, "no_data").otherwise("supported")
    out = F.when(kind == "stable_team", stable).when(kind == "no_overtime", F.when(hint, "not_supported").otherwise("no_data")).when(kind == "white_salary", pay).otherwise("no_data")
    sure = F.when(kind == "stable_team", F.when(days < 14, "low").otherwise(hist)).when(kind == "no_overtime", F.when(hint, "middle").otherwise("low")).when(kind == "white_salary", F.when(low.isNull() & high.isNull(), "middle").otherwise(hist)).otherwise("low")
    return out, sure


SENIOR = ("architecture", "roadmap", "mentoring", "strategy", "budget")


def facts(low: Column, high: Column, junior: Column, text: Column, days: Column, active: Column, wide: float = 2.0, senior: tuple[str, ...] = SENIOR, least: int = 3, long: int = 90) -> Column:
    """Array of (kind, confidence) of what a record's numbers say against it without any claim; empty of nothing.

    pay_band_wide: the upper end of the pay is `wide` times the lower or more; ends of 0 or null are none. grade_mismatch: a
    junior record whose text has `least` different terms of senior work. long_running: listed still, after `long` days.
    """
    terms = sum((F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(t)).cast("int") for t in senior), F.lit(0))
    sure = F.when(days >= 60, "high").when(days >= 14, "middle").otherwise("low")
    fact = lambda kind, when, confidence: F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(kind).alias("kind"), confidence.alias("confidence")))
    return F.array_compact(F.array(
        fact("pay_band_wide", (low > 0) & (high >= low * wide), F.lit("high")),
        fact("grade_mismatch", junior & (terms >= least), F.lit("middle")),
        fact("long_running", active & (days >= long), sure),
    ))


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
PHONE = r"\+[0-9][0-9 ()-]{8,}[0-9]"
TELEGRAM = r"(?:https?://)?t\.me/([A-Za-z0-9_]{4,})"
GITHUB = r"github\.com/([A-Za-z0-9-]{2,})"
HR_BOXES, COMMON_BOXES = ("hr", "jobs", "career", "careers", "recruiting"), ("info", "office", "contact", "mail", "hello")


def channels(text: Column) -> Column:
    """Array of (kind, value, rank) of a text's working channels, each once; personal phones are none."""
    def kind(name: str, values: Column, rank) -> Column:
        return F.transform(F.array_distinct(F.transform(values, F.lower)), lambda v: F.struct(F.lit(name).alias("kind"), v.alias("value"), rank(v).cast("int").alias("rank")))

    box = lambda v: F.regexp_extract(v, r"^([^@._+-]*)", 1)
    mails = F.filter(F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0)), lambda v: F.length(v) <= 254)
    return F.concat(
        kind("email", mails, lambda v: F.when(box(v).isin(*HR_BOXES), 8).when(box(v).isin(*COMMON_BOXES), 7).otherwise(5)),
        kind("telegram", F.regexp_extract_all(text, F.lit(TELEGRAM), F.lit(1)), lambda v: F.lit(6)),
        kind("github", F.regexp_extract_all(text, F.lit(GITHUB), F.lit(1)), lambda v: F.lit(6)),
    )


PERSONAL_HOSTS = ("facebook.com", "instagram.com", "vk.com")


def refused(text: Column, hosts: tuple[str, ...] = PERSONAL_HOSTS) -> Column:
    """Array of (kind, value) of what a text offers that is no working channel: every phone, in order, and hosts of personal pages, each once."""
    phones = F.transform(F.regexp_extract_all(text, F.lit(PHONE), F.lit(0)), lambda v: F.struct(F.lit("phone").alias("kind"), v.alias("value")))
    named = F.array_compact(F.array(*(F.when(F.contains(F.lower(text), F.lit(h)), F.struct(F.lit("host").alias("kind"), F.lit(h).alias("value"))) for h in hosts)))
    return F.concat(phones, named)


LEADS = [(1, ("head of", "director")), (2, ("lead", "team lead")), (3, ("manager",))]


def lead_rank(sentence: Column) -> Column:
    """The rank of the first leading role that a sentence names by whole words; null without one."""
    padded = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(sentence), r"[^a-z0-9]+", " ")), F.lit(" "))
    out = F.lit(None).cast("int")
    for rank, needles in reversed(LEADS):
        hit = F.lit(False)
        for n in needles:
            hit = hit | F.contains(padded, F.lit(f" {n} "))
        out = F.when(hit, F.lit(rank)).otherwise(out)
    return out


def leads(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, name, rank): names of two capitalised words in sentences that name a leading role, best rank first, each once."""
    said = rows.select(key, F.explode(F.split(text, r"[.!?\n]+")).alias("s")).withColumn("rank", lead_rank(F.col("s"))).filter("rank is not null")
    named = said.select(key, "rank", F.explode(F.regexp_extract_all("s", F.lit(r"\b([A-Z][a-z]{2,} [A-Z][a-z]{2,})\b"), F.lit(1))).alias("name"))
    return named.groupBy(key, "name").agg(F.min("rank").alias("rank"))


# The usual Latin spelling of Cyrillic letters.
LATIN = {"а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya"}


def transliterated(name: Column) -> Column:
    """Lower case in Latin letters; other letters that aren't ASCII are left out."""
    low = F.lower(name)
    for letter, latin in LATIN.items():
        low = F.replace(low, F.lit(letter), F.lit(latin))
    return F.regexp_replace(low, r"[^\x00-\x7f]", "")


def guessed_mails(first: Column, last: Column, domain: Column) -> Column:
    """Addresses by the usual templates; none where a part is missing."""
    f, l = transliterated(first), transliterated(last)  # noqa: E741
    made = F.array_distinct(F.array(F.concat(f, F.lit("."), l), F.concat(F.substring(f, 1, 1), F.lit("."), l), F.concat(F.substring(f, 1, 1), l), f))
    return F.when((f != "") & (l != "") & (domain != ""), F.transform(made, lambda m: F.concat(m, F.lit("@"), domain))).otherwise(F.array().cast("array<string>"))


AXES = ("pay", "truth", "churn", "conditions")
PATTERN_AXIS = {"late_salary": "pay", "fair_pay": "pay", "overtime": "conditions", "shouting": "conditions", "friendly": "conditions", "fired": "churn"}


def freshness(observed: Column, now: Column) -> Column:
    """exp of minus the months since over 18; 1 without a day."""
    months = F.greatest(F.datediff(F.to_date(now), observed) / 30, F.lit(0.0))
    return F.coalesce(F.exp(-months / 18), F.lit(1.0))


def company_levels(evidence: DataFrame, now: Column, combos: list[tuple[tuple[str, ...], str, int]], veto_red: str, veto_yellow: tuple[str, ...]) -> DataFrame:
    """(company, level, veto, axes) from evidence (company, code, axis, polarity, weight, trust, observed).

    On each axis red evidence, faded by age and saturated, less green evidence capped at 40. Axes with one trusted or two
    pieces count; two axes must. The worst gives the level; some codes overrule it. Combos are codes that tell more together.
    The evidence is read once.
    """
    c = F.col
    value = F.when(c("weight") > 0, c("weight") * c("trust") * freshness(c("observed"), now))
    side = lambda p: F.coalesce(F.sum(F.when(c("polarity") == p, value)), F.lit(0.0))
    late = (c("code") == veto_red) & (c("trust") > 0)
    per = evidence.groupBy("company", "axis").agg(
        side("red").alias("red"),
        side("green").alias("green"),
        F.count_if(c("weight") > 0).alias("n"),
        F.coalesce(F.max(c("trust") >= 0.8), F.lit(False)).alias("trusted"),
        F.collect_set("code").alias("codes"),
        F.count_if(late).alias("late"),
        F.max(late & (c("trust") >= 1.0)).alias("own"),
        F.min(F.when(c("code").isin(*veto_yellow), c("code"))).alias("yellow"),
    )
    axis_of = F.map_from_entries(F.collect_list(F.struct("axis", F.struct("red", "green", "n", "trusted"))))
    owners = per.groupBy("company").agg(axis_of.alias("m"), F.array_distinct(F.flatten(F.collect_list("codes"))).alias("codes"), F.sum("late").alias("late"), F.max("own").alias("own"), F.min("yellow").alias("yellow"))
    full = lambda x: 100.0 * (1.0 - F.exp(-x / 6.0))
    held = lambda x, default: F.coalesce(x, F.lit(default))
    columns, names = [], sorted(AXES)
    for axis in names:
        on = [(F.size(F.array_except(F.array(*map(F.lit, needed)), "codes")) == 0, weight) for needed, a, weight in combos if a == axis]
        more = sum((F.when(x, F.lit(float(w))).otherwise(F.lit(0.0)) for x, w in on), F.lit(0.0))
        m = c("m")[axis]
        n = held(m["n"], 0) + sum((x.cast("int") for x, _ in on), F.lit(0))
        points = F.round(full(held(m["red"], 0.0) + more) - F.least(F.lit(40.0), full(held(m["green"], 0.0))), 1)
        columns.append(F.when(n > 0, F.struct(points.alias("v"), ((n >= 2) | held(m["trusted"], False) | (more > 0)).alias("covered"))).alias(axis))
    rows = owners.select("company", "late", "own", "yellow", *columns)
    count = sum((held(c(a)["covered"].cast("int"), 0) for a in names), F.lit(0))
    rank = lambda a: F.when(c(a)["covered"], F.when(c(a)["v"] >= 50, 2).when(c(a)["v"] >= 20, 1).otherwise(0)).otherwise(F.lit(-1))
    base = F.when(count < 2, F.lit(-1)).otherwise(F.greatest(*(held(rank(a), -1) for a in names)))
    red = (c("late") >= 2) | held(c("own"), False)
    level = F.when(red, 2).when(c("yellow").isNotNull() & (base < 1), 1).otherwise(base)
    name = F.element_at(F.array(*map(F.lit, ("unknown", "green", "yellow", "red"))), (level + 2).cast("int"))
    text = F.concat_ws(",", *(F.when(c(a).isNotNull(), F.concat(F.lit(f"{a}="), F.format_string("%.1f", c(a)["v"]))) for a in names))
    return rows.select("company", name.alias("level"), F.when(red, F.lit(veto_red)).otherwise(F.coalesce("yellow", F.lit(""))).alias("veto"), text.alias("axes"))


def top_evidence(evidence: DataFrame, most: int = 3) -> DataFrame:
    """(company, place, code): the red codes of the heaviest evidence, each code once."""
    best = evidence.filter("polarity = 'red' and weight > 0").groupBy("company", "code").agg(F.max(F.col("weight") * F.col("trust")).alias("v"))
    place = F.row_number().over(Window.partitionBy("company").orderBy(F.desc("v"), "code"))
    return best.select("company", place.alias("place"), "code").filter(F.col("place") <= most)
