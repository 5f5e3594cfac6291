"""Queries of the full filter catalogues, line filters, classifiers and metrics (ids A, P, T of the operator inventory)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions import text as T
from attesta.operators import filters as flt
from attesta.operators.injection import contains_any
from attesta.plans import derived as D
from attesta.plans.registry import query
from attesta.plans.scoring import _VACANCY
from attesta.sources.tables import NOW, now, table
from attesta.streaming.events import written

# Filters -------------------------------------------------------------------------------------------------------------

_FLAGS = [
    *(c for c in _VACANCY if not c.endswith("AS company")),
    "'firm ' || CAST(o_custkey % 23 AS STRING) AS company",
    "o_custkey AS owner",
    "o_totalprice / 5000 AS score",
    "o_orderdate AS published",
    "o_orderstatus AS status",
    "o_orderkey % 2 = 0 AS notified",
    "CASE o_orderkey % 5 WHEN 0 THEN 'like' WHEN 1 THEN 'hide' ELSE NULL END AS feedback",
    "o_orderpriority AS source",
    "CASE o_orderkey % 7 WHEN 0 THEN 'likely' WHEN 1 THEN 'suspect' ELSE 'human' END AS ai",
]
# name: (value, SQL)
_VACANCY_FILTERS = {
    "q": ("SQL", "contains(title || ' ' || body, 'sql')"),
    "company": ("FIRM 1", "contains(company, 'firm 1')"),
    "area": ("3", "c_nationkey = 3"),
    "min_score": ("40", "coalesce(score, 0) >= 40"),
    "salary": ("200000", "coalesce(net, 0) >= 200000"),
    "days": ("3000", f"published >= CAST(DATE '{NOW[:10]}' - 3000 AS TIMESTAMP)"),
    "state": ("open", "status = 'O'"),
    "salary_shown": ("1", "net IS NOT NULL"),
    "notified": ("0", "NOT notified"),
    "feedback": ("none", "feedback IS NULL"),
    "contact": ("1", "contact"),
    "source": ("1-URGENT", "source = '1-URGENT'"),
    "market": ("known", "market IS NOT NULL"),
    "ai": ("flagged", "ai <> 'human'"),
    "company_level": ("good", "c_acctbal >= 5000"),
    "risk": ("none", "NOT risk"),
}


def vacancy_catalogue() -> dict[str, flt.Filter]:
    """The sixteen filters of records; a blank, unknown or wrong value is no filter."""
    c = F.col
    return {
        "q": lambda raw: F.contains(F.lower(F.concat("title", F.lit(" "), "body")), F.lower(F.lit(raw))) if raw.strip() else None,
        "company": flt.contains("company"),
        "area": flt.number(lambda x: c("c_nationkey") == int(x)),
        "min_score": flt.number(lambda x: F.coalesce("score", F.lit(0.0)) >= x),
        "salary": flt.number(lambda x: F.coalesce("net", F.lit(0.0)) >= x),
        "days": flt.number(lambda x: c("published") >= F.date_sub(F.to_date(now()), int(min(max(x, 0), 3650)))),
        "state": flt.choice({"open": c("status") == "O", "closed": c("status") != "O"}),
        "salary_shown": flt.choice({"1": c("net").isNotNull(), "0": c("net").isNull()}),
        "notified": flt.choice({"1": c("notified"), "0": ~c("notified")}),
        "feedback": flt.choice({"like": c("feedback") == "like", "hide": c("feedback") == "hide", "none": c("feedback").isNull()}),
        "contact": flt.choice({"1": c("contact"), "0": ~c("contact")}),
        "source": lambda raw: c("source") == raw if raw.strip() else None,
        "market": flt.choice({"known": c("market").isNotNull(), "unknown": c("market").isNull()}),
        "ai": flt.choice({"flagged": c("ai") != "human", "human": c("ai") == "human"}),
        "company_level": flt.choice({"good": c("c_acctbal") >= 5000, "bad": c("c_acctbal") < 0}),
        "risk": flt.choice({"some": c("risk"), "none": ~c("risk")}),
    }


def _flagged(spark, sf_dir) -> DataFrame:
    """Records with a column for each thing that a filter asks of other tables: a filter may then stand under OR or NOT."""
    li = table(spark, sf_dir, "lineitem")
    per = li.groupBy(F.col("l_orderkey").alias("key")).agg(F.max(F.col("l_quantity") > 45).alias("contact"), F.max(F.col("l_returnflag") == "R").alias("risk"))
    who = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("owner"), "c_nationkey", "c_acctbal")
    rows = table(spark, sf_dir, "orders").selectExpr(*_FLAGS).join(who, "owner", "left").join(per, "key", "left")
    return rows.withColumns({"contact": F.coalesce("contact", F.lit(False)), "risk": F.coalesce("risk", F.lit(False))})


_FLAGGED_SQL = f"""(SELECT v.*, c_nationkey, c_acctbal, coalesce(contact, false) AS contact, coalesce(risk, false) AS risk FROM (SELECT {', '.join(_FLAGS)} FROM orders) v LEFT JOIN customer ON owner = c_custkey LEFT JOIN (SELECT l_orderkey, bool_or(l_quantity > 45) AS contact, bool_or(l_returnflag = 'R') AS risk FROM lineitem GROUP BY 1) ON l_orderkey = key)"""


def counted(rows: DataFrame, catalogue: dict[str, flt.Filter], values: dict[str, str]) -> DataFrame:
    """(filter, n): how many rows each filter alone keeps, and all of the first four together; one pass."""
    conditions = {k: flt.build(catalogue, {k: v})[0] for k, v in values.items()}
    conditions["together"] = flt.build(catalogue, dict(list(values.items())[:4]) | {"other": "1", "salary_shown": "maybe"})[0]
    wide = rows.agg(*(F.count_if(c).alias(k) for k, c in conditions.items()))
    return wide.unpivot([], list(conditions), "filter", "n")


def _counted_sql(source: str, filters: dict[str, tuple[str, str]]) -> str:
    alone = " UNION ALL ".join(f"SELECT '{k}' AS filter, count(*) AS n FROM f WHERE {sql}" for k, (_, sql) in filters.items())
    first = " AND ".join(sql for _, sql in list(filters.values())[:4])
    return f"WITH f AS MATERIALIZED (SELECT * FROM {source}) {alone} UNION ALL SELECT 'together', count(*) FROM f WHERE {first}"


@query("P6", _counted_sql(_FLAGGED_SQL, _VACANCY_FILTERS))
def record_filters(spark, sf_dir):
    return counted(_flagged(spark, sf_dir), vacancy_catalogue(), {k: v for k, (v, _) in _VACANCY_FILTERS.items()})


_COMPANY_FILTERS = {
    "cq": ("BUILD", "contains(lower(c_mktsegment), 'build')"),
    "level": ("red", "c_acctbal < 0"),
    "reviews": ("3", "coalesce(n, 0) >= 3"),
    "rating": ("500", "coalesce(c_acctbal, 0) >= 500"),
    "fake": ("none", "c_custkey % 6 <> 0"),
    "ccontact": ("1", "contact"),
    "openings": ("2", "coalesce(open, 0) >= 2"),
}
_COMPANIES_SQL = "(SELECT customer.*, n, open, coalesce(contact, false) AS contact FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'O') AS open, bool_or(o_orderpriority = '1-URGENT') AS contact FROM orders GROUP BY 1) ON o_custkey = c_custkey)"


@query("P7", _counted_sql(_COMPANIES_SQL, _COMPANY_FILTERS))
def company_filters(spark, sf_dir):
    c = F.col
    catalogue = {
        "cq": flt.contains("c_mktsegment"),
        "level": flt.choice({"red": c("c_acctbal") < 0, "green": c("c_acctbal") >= 0}),
        "reviews": flt.number(lambda x: F.coalesce("n", F.lit(0)) >= x),
        "rating": flt.number(lambda x: F.coalesce("c_acctbal", F.lit(0.0)) >= x),
        "fake": flt.choice({"none": c("c_custkey") % 6 != 0, "some": c("c_custkey") % 6 == 0}),
        "ccontact": flt.choice({"1": c("contact"), "0": ~c("contact")}),
        "openings": flt.number(lambda x: F.coalesce("open", F.lit(0)) >= x),
    }
    per = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.count_if(c("o_orderstatus") == "O").alias("open"), F.max(c("o_orderpriority") == "1-URGENT").alias("contact"))
    rows = table(spark, sf_dir, "customer").join(per, "c_custkey", "left").withColumn("contact", F.coalesce("contact", F.lit(False)))
    return counted(rows, catalogue, {k: v for k, (v, _) in _COMPANY_FILTERS.items()})


@query("P24", """
WITH old AS (SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS d FROM lineitem WHERE l_linenumber <= 3 AND l_partkey % 5 <> 0)
SELECT l.l_orderkey AS page, bool_and(old.d IS NOT NULL) AS known FROM lineitem l LEFT JOIN old ON l.l_orderkey = old.l_orderkey AND l.l_linenumber = old.l_linenumber AND CAST(l.l_shipdate AS DATE) = old.d GROUP BY 1""")
def page_is_known(spark, sf_dir):
    """Whether all of a page's records are stored already, under the same publication date."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("d"), "l_partkey")
    old = lines.filter("l_linenumber <= 3 and l_partkey % 5 <> 0").select("l_orderkey", "l_linenumber", "d").distinct().withColumn("seen", F.lit(True))
    both = lines.join(old, ["l_orderkey", "l_linenumber", "d"], "left")
    return both.groupBy(F.col("l_orderkey").alias("page")).agg(F.bool_and(F.coalesce("seen", F.lit(False))).alias("known"))


# Texts ---------------------------------------------------------------------------------------------------------------

HINTS, MENU = ("work", "salary", "boss", "manager", "team", "company"), ("about", "login", "contacts", "license", "rights reserved")


@query("T26", rf"""
WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS t FROM {D.REVIEWS_SQL}), h AS (SELECT *, lower(t) AS low FROM l)
SELECT doc_id, count(*) AS kept FROM h WHERE length(t) >= 30 AND length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) / length(t)::DOUBLE >= 0.5 AND {D.any_sql('low', HINTS)} AND NOT {D.any_sql('low', MENU)} GROUP BY 1""")
def review_lines(spark, sf_dir):
    """Lines that may be a review: long, mostly letters, with a hint of work and nothing of a menu."""
    lines = D.reviews(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n")).alias("t")).withColumn("t", F.trim("t"))
    low = F.lower("t")
    ok = (F.length("t") >= 30) & (T.letters_share(F.col("t")) >= 0.5) & contains_any(low, HINTS) & ~contains_any(low, MENU)
    return lines.filter(ok).groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept"))


FAMILIES = {"hard": ("steel", "brass", "economy"), "soft": ("tin", "promo"), "fine": ("standard",)}


@query("T30", """
SELECT p_partkey AS part, CASE WHEN contains(lower(p_type), 'steel') OR contains(lower(p_type), 'brass') OR contains(lower(p_type), 'economy') THEN 'hard' WHEN contains(lower(p_type), 'tin') OR contains(lower(p_type), 'promo') THEN 'soft' WHEN contains(lower(p_type), 'standard') THEN 'fine' ELSE 'other' END AS role,
  CASE WHEN p_size >= 40 THEN 'senior' WHEN p_size >= 15 THEN 'middle' ELSE 'junior' END AS grade, CASE WHEN contains(lower(p_name), 'red') OR contains(lower(p_name), 'blue') THEN 'capital' WHEN contains(lower(p_name), 'small') THEN 'town' ELSE 'elsewhere' END AS geo, CASE WHEN contains(lower(p_name), 'widget') THEN 'remote' ELSE 'office' END AS format FROM part""")
def classified(spark, sf_dir):
    """Role, grade, place and format of a record: the first family whose marks it has."""

    def first(x, families: dict[str, tuple[str, ...]], other: str):
        out = F.lit(other)
        for name, marks in reversed(families.items()):
            out = F.when(contains_any(x, marks), name).otherwise(out)
        return out

    kind, name = F.lower("p_type"), F.lower("p_name")
    grade = F.when(F.col("p_size") >= 40, "senior").when(F.col("p_size") >= 15, "middle").otherwise("junior")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), first(kind, FAMILIES, "other").alias("role"), grade.alias("grade"), first(name, {"capital": ("red", "blue"), "town": ("small",)}, "elsewhere").alias("geo"), first(name, {"remote": ("widget",)}, "office").alias("format"))


_HOST = r"regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)), '^www\.', '')"


@query("T34", rf"""
WITH h AS (SELECT {_HOST} AS host FROM pages), d AS (SELECT host, string_split(host, '.') AS p FROM h)
SELECT host, array_to_string(p[greatest(len(p) - 1, 1):], '.') AS domain, p[-1] AS suffix, count(*) AS n, (CASE WHEN starts_with(host, 'blog.') THEN 0.5 WHEN p[-1] IN ('org', 'edu') THEN 0.9 WHEN p[-1] = 'com' THEN 0.7 ELSE 0.6 END)::DOUBLE AS trust FROM d WHERE NOT (host LIKE '%.example.net') GROUP BY ALL""")
def host_trust(spark, sf_dir):
    """Hosts, their domains and suffixes, and how far to trust them; hosts of boards are no company's."""
    h = table(spark, sf_dir, "pages").select(T.host(F.col("url")).alias("host")).filter(~F.col("host").endswith(".example.net"))
    p = F.split("host", r"\.")
    suffix = F.element_at(p, -1)
    trust = F.when(F.col("host").startswith("blog."), 0.5).when(suffix.isin("org", "edu"), 0.9).when(suffix == "com", 0.7).otherwise(0.6)
    rows = h.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("host", F.array_join(F.slice(p, F.greatest(F.size(p) - 1, F.lit(1)), 2), ".").alias("domain"), suffix.alias("suffix"), "n", trust.alias("trust"))


_GROUPED = "text || ' ' || CASE doc_id % 4 WHEN 0 THEN 'from 1 200 000 to 15,500 or 99' WHEN 1 THEN '12 34 and 1 2345' WHEN 2 THEN '1,234,567 x' ELSE '' END"


@query("T36", rf"""
WITH t AS (SELECT doc_id, regexp_extract_all({_GROUPED}, '[0-9]+(?:[ ,][0-9]+)*') AS r FROM documents), u AS (SELECT doc_id, unnest(r) AS x FROM t),
p AS (SELECT doc_id, x, regexp_extract_all(x, '[0-9]+') AS d FROM u),
j AS (SELECT doc_id, list_reduce(list_prepend('', d), lambda a, b: CASE WHEN a <> '' AND length(b) = 3 THEN a || b ELSE a || ' ' || b END) AS joined FROM p)
SELECT t.doc_id, coalesce(list_sort(list_distinct(flatten(list(string_split(trim(joined), ' ')) FILTER (joined IS NOT NULL)))), []) AS numbers FROM t LEFT JOIN j USING (doc_id) GROUP BY t.doc_id""")
def number_sets(spark, sf_dir):
    """The numbers of every text; groups of exactly three digits after a space or comma belong to the number before them."""
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_GROUPED} AS said")
    return rows.select("doc_id", T.numbers(F.col("said")).alias("numbers"))


@query("T37", r"""
WITH d AS MATERIALIZED (SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), ' ') AS t FROM documents), b AS MATERIALIZED (SELECT item_id, array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), ' ') AS t FROM benchmark)
SELECT item_id, count(doc_id) AS quoted FROM b LEFT JOIN d ON contains(d.t, b.t) GROUP BY 1""")
def verified_quotes(spark, sf_dir):
    """How many texts hold each item word for word, whatever the case, spaces and marks: items and texts meet on the item's rarest run of five words, and are then compared."""
    split = lambda c: F.split(c, r"\s+")
    alike = T.normal(F.col("text"))
    items = table(spark, sf_dir, "benchmark").select("item_id", alike.alias("item"))
    inner = items.withColumn("w", F.slice(split("item"), 2, F.greatest(F.size(split("item")) - 2, F.lit(0))))  # the outer words may be parts of longer ones
    long = inner.filter(F.size("w") >= 5).select("item_id", "item", F.explode(T.shingle_hashes(F.col("w"), 5)).alias("g"))
    docs = written(table(spark, sf_dir, "documents").select("doc_id", alike.alias("text")))  # read four times
    grams = docs.select("doc_id", F.explode(T.shingle_hashes(split("text"), 5)).alias("g")).join(long.select("g").distinct(), "g", "left_semi")
    df = grams.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    one = long.join(df, "g", "left").groupBy("item_id").agg(F.min_by("g", F.struct(F.coalesce("df", F.lit(0)), F.col("g"))).alias("g"))
    met = one.join(grams, "g").select("item_id", "doc_id")
    few = inner.filter(F.size("w") < 5).select("item_id", "item")
    hits = met.join(items, "item_id").join(docs, "doc_id").filter(F.contains("text", F.col("item"))).select("item_id", "doc_id")
    size = few.agg(F.coalesce(F.sum(F.length("item")), F.lit(0)).alias("n")).first()["n"]  # short items: their own scan, sent to tasks only while they are few
    short = docs.join(F.broadcast(few) if size < 8_000_000 else few, F.contains("text", F.col("item"))).select("item_id", "doc_id")
    n = hits.unionByName(short).groupBy("item_id").agg(F.count("doc_id").alias("n"))
    return items.select("item_id").join(n, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("quoted"))


# Metrics -------------------------------------------------------------------------------------------------------------


@query("A33", """
WITH s AS (SELECT user_id, event_type, ts, event_id, value, floor(value / 25) AS band, lag(floor(value / 25)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS before FROM events),
u AS (SELECT user_id, event_type, count(*) AS n, date_diff('second', min(ts), max(ts)) // 86400 AS days, count(*) FILTER (before IS NOT NULL AND before <> band) AS moves, min(value) AS least FROM s GROUP BY 1, 2)
SELECT user_id, count(*) AS tracked, count(*) FILTER (n >= 10) AS republished, count(*) FILTER (days >= 20) AS long_running, count(*) FILTER (moves >= 3) AS moved, count(*) FILTER (least < 5) AS no_salary, max(days)::BIGINT AS max_days FROM u GROUP BY 1""")
def history_counters(spark, sf_dir):
    days = F.floor((F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))) / 86400)
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    s = table(spark, sf_dir, "events").withColumn("band", F.floor(F.col("value") / 25)).withColumn("before", F.lag("band").over(w))
    u = s.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), days.alias("days"), F.count_if(F.col("before") != F.col("band")).alias("moves"), F.min("value").alias("least"))
    c = F.col
    return u.groupBy("user_id").agg(F.count(F.lit(1)).alias("tracked"), F.count_if(c("n") >= 10).alias("republished"), F.count_if(c("days") >= 20).alias("long_running"), F.count_if(c("moves") >= 3).alias("moved"), F.count_if(c("least") < 5).alias("no_salary"), F.max("days").alias("max_days"))


@query("A42", """
WITH r AS (SELECT l_suppkey % 5 AS model, l_returnflag AS stage, l_linenumber AS level, l_orderkey % 50 AS c, l_discount * 10 AS score, l_tax = 0 AS refused, l_orderkey % 2 AS side FROM lineitem),
g AS (SELECT stage, model, level, avg(score) AS m FROM r GROUP BY ALL), w AS (SELECT stage, model, sum(m * level) / sum(level) AS v FROM g GROUP BY ALL),
sp AS (SELECT stage, model, c, max(score) - min(score) AS d FROM r GROUP BY ALL)
SELECT 'weighted' AS metric, stage || ':' || model AS name, round(v, 6) AS value FROM w UNION ALL SELECT 'overall', model::VARCHAR, round(avg(v), 6) FROM w GROUP BY model UNION ALL SELECT 'level', level::VARCHAR, round(avg(score), 6) FROM r GROUP BY level
UNION ALL SELECT 'stability', stage || ':' || model, round(avg(d), 6) FROM sp GROUP BY stage, model UNION ALL SELECT 'order_bias', model::VARCHAR, round(avg(score) FILTER (side = 0) - avg(score) FILTER (side = 1), 6) FROM r GROUP BY model
UNION ALL SELECT 'refusals', model::VARCHAR, round(avg(refused::INT), 6) FROM r GROUP BY model UNION ALL SELECT 'separation', stage, round(max(v) - min(v), 6) FROM w GROUP BY stage""")
def bench_metrics(spark, sf_dir):
    """Seven metrics of models by stage: weighted by level, overall, by level, spread within a case, order bias, refusals, and how far a stage tells models apart."""
    c = F.col
    r = table(spark, sf_dir, "lineitem").select((c("l_suppkey") % 5).alias("model"), c("l_returnflag").alias("stage"), c("l_linenumber").alias("level"), (c("l_orderkey") % 50).alias("c"), (c("l_discount") * 10).alias("score"), (c("l_tax") == 0).alias("refused"), (c("l_orderkey") % 2).alias("side"))
    # One pass over the rows: sums per (stage, model, level) and per case; the rest are made of these.
    g = r.groupBy("stage", "model", "level").agg(F.sum("score").alias("s"), F.count(F.lit(1)).alias("n"), F.count_if("refused").alias("no"), *(f(F.when(c("side") == k, c("score"))).alias(f"{a}{k}") for k in (0, 1) for f, a in ((F.sum, "s"), (F.count, "n"))))
    w = g.groupBy("stage", "model").agg((F.sum(c("s") / c("n") * c("level")) / F.sum("level")).alias("v"))
    spread = r.groupBy("stage", "model", "c").agg((F.max("score") - F.min("score")).alias("d")).groupBy("stage", "model").agg(F.avg("d").alias("v"))
    both = F.concat("stage", F.lit(":"), c("model").cast("string"))
    per = g.groupBy("model").agg(*(F.sum(x).alias(x) for x in ("s", "n", "no", "s0", "n0", "s1", "n1")))
    rows = [
        w.select(F.lit("weighted").alias("metric"), both.alias("name"), c("v").alias("value")),
        w.groupBy("model").agg(F.avg("v").alias("value")).select(F.lit("overall").alias("metric"), c("model").cast("string").alias("name"), "value"),
        g.groupBy("level").agg((F.sum("s") / F.sum("n")).alias("value")).select(F.lit("level").alias("metric"), c("level").cast("string").alias("name"), "value"),
        spread.select(F.lit("stability").alias("metric"), both.alias("name"), c("v").alias("value")),
        per.select(F.lit("order_bias").alias("metric"), c("model").cast("string").alias("name"), (c("s0") / c("n0") - c("s1") / c("n1")).alias("value")),
        per.select(F.lit("refusals").alias("metric"), c("model").cast("string").alias("name"), (c("no") / c("n")).alias("value")),
        w.groupBy("stage").agg((F.max("v") - F.min("v")).alias("value")).select(F.lit("separation").alias("metric"), c("stage").alias("name"), "value"),
    ]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out.select("metric", "name", F.round("value", 6).alias("value"))
