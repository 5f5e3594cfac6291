"""Queries of parsers, sources and sinks over derived pages, dumps and dates (ids S and D of the operator inventory)."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.plans.registry import query
from attesta.sources import dates
from attesta.sources import pages as src
from attesta.sources.tables import NOW, now, table
from attesta.streaming.events import shared

# Derived: a page's state, as JSON of the page's id. Both engines read these expressions.
_ID = "CAST(page_id AS STRING)"
_NODE = f"""'{{"id": "v' || {_ID} || '", "name": "Job ' || {_ID} || '", "company": {{"name": "Firm ' || CAST(page_id % 7 AS STRING) || '"}}, "salary": {{"from": ' || CAST(page_id * 10 AS STRING) || ', "to": ' || CAST(page_id * 20 AS STRING) || '}}, "schedule": {{"id": "REMOTE"}}, "url": "/v/' || {_ID} || '"}}'"""
_OTHER = f"""'{{"vacancyId": "w' || {_ID} || '", "id": "w' || {_ID} || '", "title": "Role ' || {_ID} || '", "employer": "Shop", "compensation": {{"from": 5}}, "workFormat": ["Office"]}}'"""
_STATE = f"""'{{"meta": 1, "data": {{"list": [' || {_NODE} || ', ' || {_OTHER} || ', {{"id": "", "name": "no id"}}]}}, "address": {{"city": "Town ' || CAST(page_id % 3 AS STRING) || '", "lat": ' || CAST(page_id % 100 AS STRING) || ', "lng": 0, "metro": [{{"name": "A"}}, {{"name": "B' || CAST(page_id % 2 AS STRING) || '"}}]}}}}'"""
_PAGE = f"""html || CASE page_id % 4 WHEN 0 THEN '<script type="application/json">' || {_STATE} || '</script>' WHEN 1 THEN '<script>window.__STATE__ = ' || {_STATE} || ';</script>' WHEN 2 THEN '<template id="state">' || {_STATE} || '</template>' ELSE '' END"""
_MARKS = [r"(?s)<script[^>]*type=\"application/json\"[^>]*>(.*?)</script>", r"(?s)window\.__STATE__\s*=\s*(\{.*?\})\s*;?\s*</script>", r"(?s)<template[^>]*id=\"state\"[^>]*>(.*?)</template>"]
_STATES = "(SELECT page_id, url, coalesce(" + ", ".join(f"""nullif(trim(regexp_extract(page, '{m.replace(chr(92) + '"', '"')}', 1)), '')""" for m in _MARKS) + f") AS state FROM (SELECT page_id, url, {_PAGE} AS page FROM pages))"


def _pages(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages").selectExpr("page_id", "url", f"{_PAGE} AS page")


def _states(spark, sf_dir) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", "url", src.state_of(F.col("page")).alias("state"))


@query("S5", f"SELECT page_id, state FROM {_STATES}")
def states(spark, sf_dir):
    return _states(spark, sf_dir).select("page_id", "state")


_NODES = f"(SELECT page_id, url, unnest(json_extract(state, '$.data.list[*]')) AS n FROM {_STATES} WHERE state IS NOT NULL)"


def _first(*paths: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(json_extract_string(n, '$.{p}'), '')" for p in paths) + ")"


_RECORDS = f"""(SELECT page_id, url, {_first('id', 'vacancyId')} AS key, {_first('name', 'title')} AS title, {_first('company.name', 'employer.name', 'employer')} AS company,
  try_cast({_first('salary.from', 'compensation.from')} AS DOUBLE) AS low, try_cast({_first('salary.to', 'compensation.to')} AS DOUBLE) AS high, lower({_first('schedule.id', 'schedule.name', 'workFormat[0]')}) AS schedule FROM {_NODES})"""


@query("S6", f"SELECT page_id AS page, key, title, company, low, high FROM {_RECORDS} WHERE key IS NOT NULL")
def state_records(spark, sf_dir):
    return src.tree_records(_states(spark, sf_dir), "page_id", "state").select("page", "key", "title", "company", "low", "high")


@query("S7", f"SELECT page_id, key, title, company, low, high, schedule FROM {_RECORDS} WHERE key IS NOT NULL")
def typed_records(spark, sf_dir):
    nodes = _states(spark, sf_dir).select("page_id", F.explode(F.from_json(F.get_json_object("state", "$.data.list"), "array<string>")).alias("n"))
    return nodes.select("page_id", *(c.alias(k) for k, c in src.record_of(F.col("n")).items())).filter("key is not null")


@query("S11", rf"SELECT regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1) || ':' || key AS key, title FROM {_RECORDS} WHERE key IS NOT NULL AND starts_with(key, 'v')")
def clone_records(spark, sf_dir):
    """A site built on the same engine: the same records, their keys under the site's host."""
    rows = src.tree_records(_states(spark, sf_dir), "page_id", "state").filter("startswith(key, 'v')")
    own = table(spark, sf_dir, "pages").select(F.col("page_id").alias("page"), F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#:]*)", 1).alias("host"))
    return rows.join(own, "page").select(F.concat("host", F.lit(":"), "key").alias("key"), "title")


@query("S16", f"""
SELECT page_id AS page, city, CASE WHEN lat <= 90 AND (lat <> 0 OR lng <> 0) THEN lat END AS lat, CASE WHEN lat <= 90 AND (lat <> 0 OR lng <> 0) THEN lng END AS lng, 'A, B' || (page_id % 2) AS metro
FROM (SELECT page_id, json_extract_string(state, '$.address.city') AS city, json_extract(state, '$.address.lat')::DOUBLE AS lat, json_extract(state, '$.address.lng')::DOUBLE AS lng FROM {_STATES} WHERE state IS NOT NULL)""")
def addresses(spark, sf_dir):
    return src.tree_addresses(_states(spark, sf_dir), "page_id", "state")


_LD = f"""html || '<script type="application/ld+json">{{"@type": "' || CASE WHEN page_id % 3 = 0 THEN 'WebPage' ELSE 'JobPosting' END || '", "title": "Job ' || {_ID} || '", "datePosted": "2024-01-0' || CAST(1 + page_id % 9 AS STRING) || '", "hiringOrganization": {{"name": "Firm"}}, "baseSalary": {{"currency": "EUR", "value": {{"minValue": ' || {_ID} || ', "maxValue": 900}}}}}}</script><script type="application/ld+json">{{broken</script>'"""


@query("S9", f"SELECT page_id, 'Job ' || page_id AS title, DATE '2024-01-01' + (page_id % 9)::INT AS posted, 'Firm' AS company, page_id::DOUBLE AS low, 900.0::DOUBLE AS high, 'EUR' AS currency FROM (SELECT page_id, unnest(regexp_extract_all({_LD}, '(?s)<script[^>]*application/ld\\+json[^>]*>(.*?)</script>', 1)) AS b FROM pages) WHERE contains(b, '\"JobPosting\"')")
def job_postings(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").selectExpr("page_id", f"{_LD} AS page")
    return src.postings(rows, "page_id", "page")


_REVIEW = f"""'{{"@type": "Product", "review": [{{"@type": "Review", "reviewBody": "Body ' || {_ID} || '", "reviewRating": {{"ratingValue": "' || CAST(page_id % 12 AS STRING) || '", "bestRating": "10"}}}}, {{"@type": "Review", "reviewBody": "second", "reviewRating": {{"ratingValue": 4}}}}, {{"@type": "Offer"}}]}}'"""


@query("S14", f"""
SELECT page_id AS page, json_extract_string(r, '$.reviewBody') AS body, CASE WHEN v > 0 AND v <= 5 THEN round(v, 2) END AS rating FROM (
  SELECT page_id, r, json_extract_string(r, '$.reviewRating.ratingValue')::DOUBLE * 5 / coalesce(json_extract_string(r, '$.reviewRating.bestRating')::DOUBLE, 5) AS v FROM (SELECT page_id, unnest(json_extract({_REVIEW}, '$.review[*]')) AS r FROM pages) WHERE json_extract_string(r, '$."@type"') = 'Review')""")
def schema_reviews(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").selectExpr("page_id", f"{_REVIEW} AS ld")
    return src.tree_reviews(rows, "page_id", "ld")


@query("S14_scale", "SELECT event_id, CASE WHEN value * 5 / 100 > 0 AND value * 5 / 100 <= 5 THEN round(value * 5 / 100, 6) END AS rating FROM events")
def rescaled(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(src.rating5(F.col("value"), F.lit(100.0)), 6).alias("rating"))


_SITE_URL = "'https://www.' || CASE page_id % 6 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' WHEN 2 THEN 'gamma' WHEN 3 THEN 'delta' WHEN 4 THEN 'epsilon' ELSE 'other' END || '.example/r'"
_SITE_HTML = f"""'<p>top</p>' || CASE page_id % 6 WHEN 0 THEN '<div class="review" data-rating="4.5">good ' || {_ID} || '</div><div class="review">plain</div>' WHEN 1 THEN '<article><b>7</b> fine <i>place</i></article>' WHEN 2 THEN '<li class="item">3 of 5 so so</li>' WHEN 3 THEN '<section>rated 80/100 x</section>' WHEN 4 THEN '<blockquote>stars: 9 odd</blockquote>' ELSE '<article>none</article>' END"""
_SITE_SQL = " UNION ALL ".join(f"SELECT page_id, u, '{mark}' AS mark, {best} AS best FROM (SELECT page_id, regexp_extract_all(page, '{pattern}') AS u FROM sp WHERE site = '{name}')" for name, (pattern, mark, best) in src.SITES.items())


@query("S13", rf"""
WITH sp AS (SELECT page_id, regexp_extract({_SITE_URL}, '://www\.([^/]+)', 1) AS site, {_SITE_HTML} AS page FROM pages), b AS ({_SITE_SQL}),
x AS (SELECT page_id, mark, best, unnest(u) AS b, unnest(range(len(u)))::INT AS idx FROM b),
y AS (SELECT page_id, idx, trim(regexp_replace(regexp_replace(b, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS body, try_cast(nullif(CASE {' '.join(f"WHEN mark = '{m}' THEN regexp_extract(b, '{m}', 1)" for _, m, _ in src.SITES.values())} END, '') AS DOUBLE) * 5 / best AS r FROM x)
SELECT page_id, idx, body, CASE WHEN r > 0 AND r <= 5 THEN round(r, 2) END AS rating FROM y""")
def site_reviews(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").selectExpr("page_id", f"{_SITE_URL} AS u", f"{_SITE_HTML} AS page")
    return src.site_reviews(rows, "page_id", "u", "page")


@query("S10", "SELECT 'a:' || s_suppkey AS key, s_name AS title, s_acctbal AS low FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT 'b:' || s_suppkey, s_name, CASE WHEN s_acctbal > 0 THEN s_acctbal END FROM supplier WHERE s_suppkey % 2 = 1")
def rest_dumps(spark, sf_dir):
    """Two services' answers, one JSON text to a line, with their own layouts; a payment of nothing counts as none in the second."""
    s, path = table(spark, sf_dir, "supplier"), shared(spark)
    one = F.to_json(F.struct(F.struct(F.array(F.struct(F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("job-name"), F.col("s_acctbal").alias("salary_min")).alias("vacancy"))).alias("vacancies")).alias("results")))
    two = F.to_json(F.struct(F.array(F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("profession"), F.col("s_acctbal").alias("payment_from"))).alias("objects")))
    s.filter("s_suppkey % 2 = 0").select(one.alias("value")).write.text(f"{path}/a")
    s.filter("s_suppkey % 2 = 1").select(two.alias("value")).write.text(f"{path}/b")
    a = src.read_lines(spark, f"{path}/a", "results struct<vacancies:array<struct<vacancy:struct<id:long,`job-name`:string,salary_min:double>>>>")
    b = src.read_lines(spark, f"{path}/b", "objects array<struct<id:long,profession:string,payment_from:double>>")
    first = a.select(F.explode("results.vacancies.vacancy").alias("v")).select(F.concat(F.lit("a:"), "v.id").alias("key"), F.col("v.job-name").alias("title"), F.col("v.salary_min").alias("low"))
    return first.unionByName(b.select(F.explode("objects").alias("v")).select(F.concat(F.lit("b:"), "v.id").alias("key"), F.col("v.profession").alias("title"), F.when(F.col("v.payment_from") > 0, F.col("v.payment_from")).alias("low")))


@query("S12", "SELECT p_partkey AS key, p_name AS title, coalesce(CASE WHEN p_partkey % 3 = 0 THEN p_type END, p_brand) AS kind, coalesce(CASE WHEN p_partkey % 3 = 0 AND p_size > 10 THEN p_retailprice END, p_size::DOUBLE) AS low FROM part")
def enriched(spark, sf_dir):
    """Items of a search list, overridden by their details where there are any."""
    p = table(spark, sf_dir, "part")
    items = p.select(F.col("p_partkey").alias("key"), F.col("p_name").alias("title"), F.col("p_brand").alias("kind"), F.col("p_size").cast("double").alias("low"))
    details = p.filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("key"), F.col("p_type").alias("d_kind"), F.when(F.col("p_size") > 10, F.col("p_retailprice")).alias("d_low"))
    return items.join(details, "key", "left").select("key", "title", F.coalesce("d_kind", "kind").alias("kind"), F.coalesce("d_low", "low").alias("low"))


@query("S18", "SELECT doc_id, lang, ('0x' || substr(sha1('0' || doc_id), 1, 8))::BIGINT / 4294967296.0 < 0.1 AS val FROM documents")
def split_sink(spark, sf_dir):
    path = f"{shared(spark)}/sets-{uuid.uuid4().hex}"
    src.write_lines(table(spark, sf_dir, "documents").select("doc_id", "lang"), path, "doc_id")
    side = lambda name: spark.read.schema("doc_id long, lang string").json(f"{path}/{name}").withColumn("val", F.lit(name == "val"))
    return side("train").unionByName(side("val"))


PROFILES = [{"id": "eng", "title": "Engineer", "skills": ["SQL", "Spark"], "min_score": 45, "weights": {"skills": 55}}, {"id": "mgr", "title": "Manager", "skills": [], "min_score": "high"}, {"id": "bad", "skills": ["x"], "min_score": 130}, {"title": "no id"}]


@query("S19", "SELECT * FROM (VALUES ('eng', 'Engineer', ['spark', 'sql'], 45.0::DOUBLE, ''), ('mgr', 'Manager', []::VARCHAR[], 45.0::DOUBLE, 'min_score is no number'), ('bad', '', ['x'], 100.0::DOUBLE, 'min_score beyond 0 to 100,no title')) t(id, title, skills, min_score, notes)")
def profiles(spark, sf_dir):
    """Profiles from a file of JSON lines: wrong or odd values become defaults, with a note; a profile without id is refused."""
    path = f"{shared(spark)}/profiles"
    spark.createDataFrame([(json.dumps(p),) for p in PROFILES], "value string").write.text(path)  # a configuration of a few lines
    raw = spark.read.text(path)
    at = lambda name: F.get_json_object("value", f"$.{name}")
    score = at("min_score").try_cast("double")
    note = lambda on, text: F.when(on, F.lit(text))
    notes = F.array_compact(F.array(note(score.isNull() & at("min_score").isNotNull(), "min_score is no number"), note((score < 0) | (score > 100), "min_score beyond 0 to 100"), note(at("title").isNull(), "no title")))
    skills = F.array_sort(F.transform(F.coalesce(F.from_json(at("skills"), "array<string>"), F.array().cast("array<string>")), F.lower))
    rows = raw.select(at("id").alias("id"), F.coalesce(at("title"), F.lit("")).alias("title"), skills.alias("skills"), F.least(F.greatest(F.coalesce(score, F.lit(45.0)), F.lit(0.0)), F.lit(100.0)).alias("min_score"), F.array_join(notes, ",").alias("notes"))
    return rows.filter("id is not null")


@query("S20", "SELECT item_id, item_id % 5 = 0 AS verdict, (row_number() OVER (ORDER BY item_id) - 1)::INT AS place FROM benchmark")
def imported_labels(spark, sf_dir):
    """An owner's labels: one JSON with the judged items in order and the numbers of those that are true."""
    ids = table(spark, sf_dir, "benchmark").agg(F.sort_array(F.collect_list("item_id")).alias("items"), F.sort_array(F.collect_list(F.when(F.col("item_id") % 5 == 0, F.col("item_id")))).alias("yes"))
    path = f"{shared(spark)}/labels"
    ids.write.json(path)
    rows = src.read_lines(spark, path, "items array<long>, yes array<long>")
    return rows.select("yes", F.posexplode("items").alias("place", "item_id")).select("item_id", F.array_contains("yes", F.col("item_id")).alias("verdict"), "place")


@query("S22", "SELECT 'INFO' AS level, event_type || ' ' || CASE WHEN event_id >= 100 THEN 'N' ELSE event_id::VARCHAR END AS message, count(*) AS n, max_by(event_type || ' ' || event_id, (date_trunc('second', ts), event_id)) AS last FROM events GROUP BY 2")
def log_lines(spark, sf_dir):
    """A log's lines, written as text and read back; numbers of three digits or more are masked."""
    path = f"{shared(spark)}/log"
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" INFO "), "event_type", F.lit(" "), F.col("event_id").cast("string"))
    table(spark, sf_dir, "events").select(line.alias("value")).write.text(path)
    return src.log_summary(spark.read.text(path))


@query("W11", "SELECT * FROM (VALUES ('orders', (SELECT count(*) FROM orders)), ('events', (SELECT count(*) FROM events)), ('orders after', 0), ('events after', 0)) t(target, n)")
def wiped(spark, sf_dir):
    """Counts of targets before and after they are overwritten with nothing, dependants first."""
    out, path = None, shared(spark)
    for name in ("events", "orders"):
        rows = table(spark, sf_dir, name)
        rows.write.parquet(f"{path}/{name}")
        for label, mode in ((name, None), (f"{name} after", "overwrite")):
            if mode:
                rows.limit(0).write.mode(mode).parquet(f"{path}/{name}")
            n = spark.read.schema(rows.schema).parquet(f"{path}/{name}").count()
            one = spark.range(1).select(F.lit(label).alias("target"), F.lit(n).cast("long").alias("n"))
            out = one if out is None else out.unionByName(one)
    return out


# Dates ---------------------------------------------------------------------------------------------------------------

_E = "CAST(event_id AS STRING)"
_RAW = f"""CASE event_id % 14 WHEN 0 THEN CAST(1700000000 + event_id AS STRING) WHEN 1 THEN CAST(1700000000000 + event_id AS STRING) WHEN 2 THEN 'seen 2024-01-1' || CAST(event_id % 10 AS STRING) WHEN 3 THEN '2024-01-15T10:2' || CAST(event_id % 10 AS STRING) WHEN 4 THEN '2023-12-31 23:59:5' || CAST(event_id % 10 AS STRING)
  WHEN 5 THEN 'Today' WHEN 6 THEN 'day before yesterday' WHEN 7 THEN CAST(event_id % 50 AS STRING) || ' days ago' WHEN 8 THEN '2 Weeks ago' WHEN 9 THEN '12 March' WHEN 10 THEN '5 jan. 2021' WHEN 11 THEN '{{"value": "2024-01-0' || CAST(1 + event_id % 9 AS STRING) || '"}}' WHEN 12 THEN '["3 hours ago"]' ELSE 'sometime' END"""
_DAY = f"DATE '{NOW[:10]}'"
_MONTH = "list_position(['" + "', '".join(dates.MONTHS) + "'], substr({}, 1, 3))"
_AGO = r"([0-9]{1,4})\s+(minute|hour|day|week|month|year)s?\s+ago"
_UNIT = f"CASE regexp_extract(low, '{_AGO}', 2) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in dates.UNITS.items()) + " END"
_AGO_SQL = f"{_DAY} - (nullif(regexp_extract(low, '{_AGO}', 1), '')::INT * {_UNIT})::INT"
_WORDS = "coalesce(" + ", ".join(f"CASE WHEN contains(low, '{w}') THEN {_DAY} - {n} END" for w, n in dates.WORDS) + ")"


@query("D1", rf"""
WITH d0 AS (SELECT event_id, {_RAW} AS raw FROM events), d1 AS (SELECT event_id, trim(CASE WHEN raw LIKE '{{%' THEN json_extract_string(raw, '$.value') WHEN raw LIKE '[%' THEN json_extract_string(raw, '$[0]') ELSE raw END) AS t FROM d0),
d2 AS (SELECT event_id, t, lower(t) AS low, CASE WHEN regexp_matches(t, '^-?[0-9]{{9,}}$') THEN t::DOUBLE END AS ep, regexp_extract(t, '([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})', 1) AS da, regexp_extract(t, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[T ]([0-9]{{2}}:[0-9]{{2}})', 1) AS cl, regexp_extract(t, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[T ][0-9]{{2}}:[0-9]{{2}}(:[0-9]{{2}})', 1) AS se FROM d1),
d3 AS (SELECT *, try_cast(regexp_extract(low, '([0-9]{{1,2}})\s+([a-z]{{3,}})', 1) AS INT) AS dd, {_MONTH.format("regexp_extract(low, '([0-9]{1,2})" + chr(92) + "s+([a-z]{3,})', 2)")} AS mm, try_cast(nullif(regexp_extract(low, '([0-9]{{1,2}})\s+([a-z]{{3,}})\.?\s*([0-9]{{4}})?', 3), '') AS INT) AS yy FROM d2),
d4 AS (SELECT *, try_cast(printf('%04d-%02d-%02d', coalesce(yy, {NOW[:4]}), mm, dd) AS DATE) AS nm FROM d3)
SELECT event_id, coalesce(strftime(make_timestamp((CASE WHEN abs(ep) > 1e11 THEN ep * 1000 ELSE ep * 1000000 END)::BIGINT), '%Y-%m-%dT%H:%M:%S'), CASE WHEN da <> '' THEN CASE WHEN cl = '' THEN da ELSE da || 'T' || cl || CASE WHEN se = '' THEN ':00' ELSE se END END END,
  coalesce({_WORDS}, {_AGO_SQL}, CASE WHEN yy IS NULL AND nm > {_DAY} + 1 THEN (nm - INTERVAL 12 MONTH)::DATE ELSE nm END)::VARCHAR) AS published FROM d4""")
def published(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("event_id", f"{_RAW} AS raw").select("event_id", dates.published(F.col("raw"), now()).alias("published"))


_SAID = "CASE event_id % 8 WHEN 0 THEN 'left on 05.11.2023 by Ann' WHEN 1 THEN 'posted 7 December 2023, edited' WHEN 2 THEN CAST(event_id % 6 AS STRING) || ' days ago' WHEN 3 THEN '3 months ago' WHEN 4 THEN 'written yesterday' WHEN 5 THEN 'March 2022' WHEN 6 THEN '45.13.2023' ELSE 'no date' END"


@query("D2", rf"""
WITH d AS (SELECT event_id, lower({_SAID}) AS low FROM events),
e AS (SELECT event_id, try_cast(regexp_extract(low, '\b([0-9]{{1,2}})\.([0-9]{{1,2}})\.([0-9]{{4}})\b', 3) || '-' || lpad(regexp_extract(low, '\b([0-9]{{1,2}})\.([0-9]{{1,2}})\.([0-9]{{4}})\b', 2), 2, '0') || '-' || lpad(regexp_extract(low, '\b([0-9]{{1,2}})\.([0-9]{{1,2}})\.([0-9]{{4}})\b', 1), 2, '0') AS DATE) AS a,
  try_cast(printf('%04d-%02d-%02d', try_cast(nullif(regexp_extract(low, '\b([0-9]{{1,2}}) ([a-z]{{3,9}}) ([0-9]{{4}})\b', 3), '') AS INT), {_MONTH.format("regexp_extract(low, '" + chr(92) + "b([0-9]{1,2}) ([a-z]{3,9}) ([0-9]{4})" + chr(92) + "b', 2)")}, try_cast(nullif(regexp_extract(low, '\b([0-9]{{1,2}}) ([a-z]{{3,9}}) ([0-9]{{4}})\b', 1), '') AS INT)) AS DATE) AS b,
  {_AGO_SQL} AS c, {_UNIT} AS u, {_WORDS} AS w,
  try_cast(printf('%04d-%02d-01', try_cast(nullif(regexp_extract(low, '\b([a-z]{{3,9}}) ([0-9]{{4}})\b', 2), '') AS INT), {_MONTH.format("regexp_extract(low, '" + chr(92) + "b([a-z]{3,9}) ([0-9]{4})" + chr(92) + "b', 1)")}) AS DATE) AS m FROM d)
SELECT event_id, coalesce(a, b, c, w, m) AS day, CASE WHEN a IS NOT NULL OR b IS NOT NULL THEN 'exact' WHEN c IS NOT NULL THEN CASE WHEN u <= 7 THEN 'approx' ELSE 'month' END WHEN w IS NOT NULL THEN 'approx' WHEN m IS NOT NULL THEN 'month' ELSE 'none' END AS precision FROM e""")
def reviewed(spark, sf_dir):
    d, p = dates.reviewed(F.col("said"), now())
    return table(spark, sf_dir, "events").selectExpr("event_id", f"{_SAID} AS said").select("event_id", d.alias("day"), p.alias("precision"))


@query("D8", "SELECT p_partkey AS part, true AS stamped FROM part")
def stamped(spark, sf_dir):
    """Rows that a store stamps when they are written: no stamp given, so the moment of the query."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.lit(None).cast("timestamp").alias("given"))
    made = rows.withColumn("created_at", F.coalesce("given", F.current_timestamp()))
    return made.select(F.col("p_partkey").alias("part"), (F.abs(F.unix_timestamp("created_at") - F.unix_timestamp(F.current_timestamp())) < 1).alias("stamped"))
