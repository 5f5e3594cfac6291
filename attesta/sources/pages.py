"""Records from web pages: state embedded as JSON, JSON-LD postings, links, review blocks; and JSON-lines files."""

from __future__ import annotations

import html as html_lib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "key string, title string, company string, url string, low double, high double"


def _plain(value):
    """What a field says: of a node, its name; nothing of an empty value."""
    if isinstance(value, dict):
        value = next((value[k] for k in ("name", "text", "value") if value.get(k)), None)
    return None if value is None or value == "" or value == [] else value


def _named(node: dict, *fields: str):
    return next((v for v in (_plain(node.get(f)) for f in fields) if v is not None), None)


def tree_nodes(text: str | None, accept: Callable[[dict], bool]) -> Iterator[dict]:
    """Every node of a JSON text that is accepted, by depth, then in order; nothing of what isn't JSON."""
    try:
        level = [json.loads(text)] if text else []
    except ValueError:
        return
    while level:
        after = []
        for x in level:
            if isinstance(x, dict):
                if accept(x):
                    yield x
                after.extend(v for v in x.values() if isinstance(v, (dict, list)))
            elif isinstance(x, list):
                after.extend(v for v in x if isinstance(v, (dict, list)))
        level = after


def tree_table(pages: DataFrame, key: str, state: str, accept: Callable[[dict], bool], row: Callable[[dict], tuple], schema: str) -> DataFrame:
    """(page, *schema): a row of each accepted node, wherever it is in a page's JSON. There are no fixed paths, so it is Python over Arrow batches."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(k, *row(x)) for k, t in zip(b["k"], b["t"]) for x in tree_nodes(t, accept)], columns=["page", *names])

    kind = dict(pages.dtypes)[key]
    return pages.select(F.col(key).alias("k"), F.col(state).alias("t")).mapInPandas(run, f"page {kind}, {schema}")


def tree_records(pages: DataFrame, key: str, state: str) -> DataFrame:
    """Records found anywhere in a page's JSON state: nodes that have an id and a title."""

    def number(pay, end: str) -> float | None:
        v = pay.get(end) if isinstance(pay, dict) else None
        return float(v) if isinstance(v, (int, float)) else None

    def row(x: dict) -> tuple:
        pay = x.get("salary") or x.get("compensation")
        return str(_named(x, "id", "key")), _named(x, "name", "title"), _named(x, "company", "employer"), _named(x, "url", "link"), number(pay, "from"), number(pay, "to")

    return tree_table(pages, key, state, lambda x: _named(x, "id", "key") is not None and isinstance(_named(x, "name", "title"), str), row, RECORD)


def tree_reviews(pages: DataFrame, key: str, state: str) -> DataFrame:
    """(page, body, rating) of nodes that say they are reviews; ratings on a scale to five, null beyond it."""

    def row(x: dict) -> tuple:
        r = x.get("reviewRating") or {}
        try:
            value, best = float(r.get("ratingValue")), float(r.get("bestRating") or 5)
        except (TypeError, ValueError):
            return _named(x, "reviewBody", "description"), None
        value = value * 5 / best if best > 0 else 0
        return _named(x, "reviewBody", "description"), round(value, 2) if 0 < value <= 5 else None

    return tree_table(pages, key, state, lambda x: x.get("@type") == "Review", row, "body string, rating double")


def tree_addresses(pages: DataFrame, key: str, state: str) -> DataFrame:
    """(page, city, lat, lng, metro) of address nodes; a point that is off the globe or at 0, 0 is null."""

    def row(x: dict) -> tuple:
        lat, lng = x.get("lat", x.get("latitude")), x.get("lng", x.get("longitude"))
        ok = all(isinstance(v, (int, float)) for v in (lat, lng)) and abs(lat) <= 90 and abs(lng) <= 180 and (lat or lng)
        metro = [_plain(m) for m in x.get("metro") or []]
        return _named(x, "city"), float(lat) if ok else None, float(lng) if ok else None, ", ".join(m for m in metro if m)

    return tree_table(pages, key, state, lambda x: "city" in x and ("lat" in x or "latitude" in x), row, "city string, lat double, lng double, metro string")


def record_of(node: Column) -> dict[str, Column]:
    """Fields of a JSON node: the first path of each that isn't empty."""
    first = lambda *paths: F.coalesce(*(F.nullif(F.get_json_object(node, f"$.{p}"), F.lit("")) for p in paths))
    return {
        "key": first("id", "vacancyId"),
        "title": first("name", "title"),
        "company": first("company.name", "employer.name", "employer"),
        "low": first("salary.from", "compensation.from").try_cast("double"),
        "high": first("salary.to", "compensation.to").try_cast("double"),
        "schedule": F.lower(first("schedule.id", "schedule.name", "workFormat[0]")),
    }


# Each site's blocks and the group of its text and its rating; the rating's scale.
SITES = {
    "alpha.example": (r'(?s)<div class="review"[^>]*>.*?</div>', r'data-rating="([0-9.]+)"', 5),
    "beta.example": (r"(?s)<article\b.*?</article>", r"<b>([0-9.]+)</b>", 10),
    "gamma.example": (r'(?s)<li class="item"[^>]*>.*?</li>', r"([0-9.]+) of 5", 5),
    "delta.example": (r"(?s)<section\b.*?</section>", r"rated ([0-9.]+)/100", 100),
    "epsilon.example": (r"(?s)<blockquote\b.*?</blockquote>", r"stars: ([0-9.]+)", 5),
}


def site_reviews(pages: DataFrame, key: str, url: str, html: str, sites: dict[str, tuple[str, str, float]] = SITES) -> DataFrame:
    """(key, idx, body, rating) of review pages, by the parser of their host; other hosts have none."""
    from attesta.functions.text import host

    site, blocks, rating = host(F.col(url)), F.lit(None).cast("array<string>"), F.lit(None).cast("double")
    for name, (pattern, _, _) in sites.items():
        blocks = F.when(site == name, F.regexp_extract_all(html, F.lit(pattern), F.lit(0))).otherwise(blocks)
    rows = pages.select(key, site.alias("site"), F.posexplode(blocks).alias("idx", "b"))
    for name, (_, mark, best) in sites.items():
        rating = F.when(F.col("site") == name, F.nullif(F.regexp_extract("b", mark, 1), F.lit("")).try_cast("double") * 5 / best).otherwise(rating)
    body = F.trim(F.regexp_replace(F.regexp_replace("b", r"<[^>]+>", " "), r"\s+", " "))
    return rows.select(key, "idx", body.alias("body"), F.round(F.when((rating > 0) & (rating <= 5), rating), 2).alias("rating"))


def state_of(html: Column) -> Column:
    """The JSON that a page embeds, by the first of several marks; null without one."""
    marks = [r"(?s)<script[^>]*type=\"application/json\"[^>]*>(.*?)</script>", r"(?s)window\.__STATE__\s*=\s*(\{.*?\})\s*;?\s*</script>", r"(?s)<template[^>]*id=\"state\"[^>]*>(.*?)</template>"]
    return F.coalesce(*(F.nullif(F.trim(F.regexp_extract(html, m, 1)), F.lit("")) for m in marks))


POSTING = "title string, datePosted string, hiringOrganization struct<name:string>, baseSalary struct<currency:string,value:struct<minValue:double,maxValue:double>>, `@type` string"


def postings(pages: DataFrame, key: str, html: str) -> DataFrame:
    """JobPosting records of JSON-LD scripts; what doesn't parse is left out."""
    blocks = F.regexp_extract_all(html, F.lit(r"(?s)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    nodes = pages.select(key, F.explode(blocks).alias("b")).select(key, F.from_json("b", POSTING).alias("p")).filter("p.`@type` = 'JobPosting'")
    return nodes.select(key, "p.title", F.to_date("p.datePosted").alias("posted"), F.col("p.hiringOrganization.name").alias("company"), F.col("p.baseSalary.value.minValue").alias("low"), F.col("p.baseSalary.value.maxValue").alias("high"), F.col("p.baseSalary.currency").alias("currency"))


def links(pages: DataFrame, key: str, html: str, pattern: str = r"href=\"([^\"]+)\"") -> DataFrame:
    """(key, link) once each."""
    return pages.select(key, F.explode(F.array_distinct(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)))).alias("link"))


def review_blocks(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, idx, html) of a page's items, by the first way of splitting that finds any: articles, list items, paragraphs."""
    ways = [r"(?s)<article\b.*?</article>", r"(?s)<li\b[^>]*class=\"[^\"]*review[^\"]*\".*?</li>", r"(?s)<p\b[^>]*>.*?</p>"]
    found = [F.regexp_extract_all(html, F.lit(w), F.lit(0)) for w in ways]
    pick = found[-1]
    for f in reversed(found[:-1]):
        pick = F.when(F.size(f) > 0, f).otherwise(pick)
    return pages.select(key, F.posexplode(pick).alias("idx", "html"))


def rating5(raw: Column, best: Column) -> Column:
    """A rating on a scale to `best` as one to five; null beyond it."""
    r = raw * 5 / best
    return F.when((best > 0) & (r > 0) & (r <= 5), r)


def unescape(text: Column) -> Column:
    """Every HTML entity read."""
    from pyspark.sql.types import StringType

    return F.pandas_udf(lambda s: s.map(lambda t: None if t is None else html_lib.unescape(t)), StringType())(text)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON-lines file; lines that don't parse are left out."""
    rows = spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.filter("_bad is null").drop("_bad")


def write_lines(rows: DataFrame, path: str, key: str, share: float = 0.1, seed: str = "0") -> None:
    """JSON lines in two folders, train and val; a row's side follows from a hash of seed and key alone."""
    side = F.conv(F.substring(F.sha1(F.concat(F.lit(seed), F.col(key).cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / float(16**8)
    marked = rows.withColumn("__val", side < share)
    marked.filter("not __val").drop("__val").write.mode("overwrite").json(f"{path}/train")
    marked.filter("__val").drop("__val").write.mode("overwrite").json(f"{path}/val")


def log_summary(lines: DataFrame) -> DataFrame:
    """(level, message, n, last) of a log's lines `value`: messages with long numbers masked, counted, with the last line of each."""
    parts = lines.select(F.regexp_extract("value", r"^(\S+ \S+) (\w+) (.*)$", 2).alias("level"), F.regexp_extract("value", r"^(\S+ \S+) (\w+) (.*)$", 3).alias("m"), F.regexp_extract("value", r"^(\S+ \S+) ", 1).alias("at"))
    kept = parts.filter("level <> ''").withColumn("message", F.regexp_replace("m", r"\d{3,}", "N"))
    return kept.groupBy("level", "message").agg(F.count(F.lit(1)).alias("n"), F.max_by("m", "at").alias("last"))
