"""Queries of aggregations and windows: ids A and N of the operator inventory."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from attesta.operators import aggregates as agg
from attesta.operators import history as hist
from attesta.operators.selection import quantiles
from attesta.plans.registry import query
from attesta.sources.tables import NOW, now, table
from attesta.streaming.events import written


@query("A1", """
SELECT c_nationkey AS nation, count(*) AS total, count(*) FILTER (c_acctbal >= 0) AS solvent,
  count(*) FILTER (EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)) AS ordered,
  count(*) FILTER (EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')) AS urgent
FROM customer c GROUP BY c_nationkey""")
def funnel(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    steps = {"solvent": F.col("c_acctbal") >= 0, "ordered": orders, "urgent": orders.filter("o_orderpriority = '1-URGENT'")}
    return agg.funnel(table(spark, sf_dir, "customer"), "c_custkey", steps, ["c_nationkey"]).withColumnRenamed("c_nationkey", "nation")


@query("A2", "SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (value >= 50) AS high FROM events GROUP BY 1")
def daily(spark, sf_dir):
    return agg.daily_series(table(spark, sf_dir, "events"), "ts", high=F.col("value") >= 50)


@query("A3", """
WITH p AS (SELECT o_orderpriority AS priority, CASE WHEN o_orderstatus = 'F' THEN o_totalprice WHEN o_orderstatus = 'O' THEN o_totalprice * 0.87 END AS point, o_orderstatus FROM orders)
SELECT priority, count(*) AS n, count(point) AS shown, count(*) FILTER (o_orderstatus = 'O') AS gross, round(coalesce(quantile_cont(point, 0.5), 0), 2) AS median FROM p GROUP BY priority""")
def points(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    point = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).when(F.col("o_orderstatus") == "O", F.col("o_totalprice") * 0.87)
    rows = o.select(F.col("o_orderpriority").alias("priority"), point.alias("point"), "o_orderstatus")
    counts = rows.groupBy("priority").agg(F.count(F.lit(1)).alias("n"), F.count("point").alias("shown"), F.count_if(F.col("o_orderstatus") == "O").alias("gross"))
    middle = quantiles(rows, ["priority"], "point", [0.5]).select("priority", "q")
    return counts.join(middle, "priority", "left").select("priority", "n", "shown", "gross", F.round(F.coalesce(F.col("q")[0], F.lit(0.0)), 2).alias("median"))


@query("A4", "SELECT c_mktsegment AS segment, round(coalesce(quantile_cont(c_acctbal, 0.5), 0), 2) AS median FROM customer GROUP BY 1")
def medians(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment"), "c_acctbal")
    middle = quantiles(rows, ["segment"], "c_acctbal", [0.5]).select("segment", "q")
    return rows.select("segment").distinct().join(middle, "segment", "left").select("segment", F.round(F.coalesce(F.col("q")[0], F.lit(0.0)), 2).alias("median"))


@query("A5", """
WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
c AS (SELECT least(11, floor((o_totalprice - lo) / ((hi - lo) / 12)))::BIGINT AS bin, count(*) AS n FROM orders, e GROUP BY 1)
SELECT b.range AS bin, round(lo + b.range * ((hi - lo) / 12), 4) AS lo, round(lo + (b.range + 1) * ((hi - lo) / 12), 4) AS hi, coalesce(n, 0) AS n FROM range(12) b CROSS JOIN e LEFT JOIN c ON c.bin = b.range""")
def price_histogram(spark, sf_dir):
    h = agg.histogram(table(spark, sf_dir, "orders"), F.col("o_totalprice"))
    return h.select("bin", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"), "n")


@query("A6", """
SELECT name, n FROM (SELECT CASE WHEN trim(coalesce(p_brand, '')) = '' THEN '(none)' ELSE p_brand END AS name, count(*) AS n
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) ORDER BY n DESC, name LIMIT 10""")
def top_brands(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_partkey").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return agg.top_groups(rows, F.col("p_brand"), 10)


@query("A7", "SELECT o_orderstatus AS level, count(*) AS n FROM orders GROUP BY 1")
def by_level(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query("A8", """
WITH f AS (SELECT p_partkey, unnest(string_split(p_type, ' ')) AS flag FROM part)
SELECT flag, n, (SELECT count(DISTINCT p_partkey) FROM f WHERE flag <> '') AS with_any FROM (SELECT flag, count(*) AS n FROM f WHERE flag <> '' GROUP BY flag) ORDER BY n DESC, flag LIMIT 10""")
def flags(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", F.filter(F.split("p_type", " "), lambda w: w != "").alias("flags"))
    with_any = parts.filter(F.size("flags") > 0).agg(F.countDistinct("p_partkey").alias("with_any"))
    top = parts.select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "flag").limit(10)
    return top.join(F.broadcast(with_any))  # one row


@query("A9", """
WITH u AS (SELECT user_id, date_diff('second', min(ts), max(ts)) / 86400.0 AS days, least(count(DISTINCT event_type), 4) AS kinds FROM events GROUP BY user_id)
SELECT kinds, count(*) AS n, round(quantile_cont(days, 0.5), 4) AS median_days FROM u GROUP BY kinds""")
def lifetime(spark, sf_dir):
    days = (F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))) / 86400
    u = table(spark, sf_dir, "events").groupBy("user_id").agg(days.alias("days"), F.least(F.countDistinct("event_type"), F.lit(4)).alias("kinds"))
    return quantiles(u, ["kinds"], "days", [0.5]).select("kinds", "n", F.round(F.col("q")[0], 4).alias("median_days"))


@query("A10", f"SELECT event_type, count(DISTINCT user_id) AS users FROM events WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 14 DAY GROUP BY 1")
def distinct_in_window(spark, sf_dir):
    recent = table(spark, sf_dir, "events").filter(F.col("ts") >= now() - F.expr("INTERVAL 14 DAYS"))
    return recent.groupBy("event_type").agg(F.countDistinct("user_id").alias("users"))


@query("A11", f"SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY GROUP BY 1")
def stage_in_window(spark, sf_dir):
    return table(spark, sf_dir, "events").filter(F.col("ts") >= now() - F.expr("INTERVAL 7 DAYS")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("A12", "SELECT count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS returned, count(DISTINCT l_suppkey) AS suppliers FROM lineitem")
def measures(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.countDistinct("l_suppkey").alias("suppliers"))


@query("A13", "SELECT c_mktsegment AS profile, count(*) AS n FROM customer GROUP BY 1 ORDER BY n DESC, profile")
def profiles(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("profile")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "profile")


@query("A14", "SELECT (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS open, (SELECT count(*) FROM customer) AS customers, (SELECT count(*) FROM events) AS events")
def totals(spark, sf_dir):
    one = lambda name, **cond: table(spark, sf_dir, name).agg(*(F.count_if(c).alias(k) for k, c in cond.items()))
    o = one("orders", orders=F.lit(True), open=F.col("o_orderstatus") == "O")
    return o.join(F.broadcast(one("customer", customers=F.lit(True)))).join(F.broadcast(one("events", events=F.lit(True))))  # one row each


@query("A15", "SELECT count(*) AS total, count(*) FILTER (length(props) > 2) AS with_props, count(*) FILTER (value > 0) AS with_value, count(*) FILTER (event_type <> 'error') AS healthy FROM events")
def covered(spark, sf_dir):
    return agg.coverage(table(spark, sf_dir, "events"), with_props=F.length("props") > 2, with_value=F.col("value") > 0, healthy=F.col("event_type") != "error")


@query("A16", "SELECT count(DISTINCT event_type || ':' || user_id) AS pairs FROM events")
def distinct_pairs(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.countDistinct(F.concat_ws(":", "event_type", F.col("user_id").cast("string"))).alias("pairs"))


@query("A17", "SELECT l_partkey AS part, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= 3")
def widespread(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(F.countDistinct("l_suppkey").alias("suppliers")).filter("suppliers >= 3")


@query("A18", """
SELECT event_type, count(*) AS unique_users FROM (SELECT user_id, CAST(ts AS DATE) AS day, min(event_type) AS event_type FROM events GROUP BY 1, 2 HAVING count(DISTINCT event_type) = 1) GROUP BY 1""")
def unique_to_one(spark, sf_dir):
    days = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.min("event_type").alias("event_type"), F.countDistinct("event_type").alias("k")).filter("k = 1")
    return days.groupBy("event_type").agg(F.count(F.lit(1)).alias("unique_users"))


@query("A19", "SELECT o_orderpriority AS area, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, lower(area)")
def nocase_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("area")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.lower("area"))


@query("A20", """
SELECT l_returnflag AS source, round(100.0 * avg(CASE WHEN l_discount > 0 THEN 1 ELSE 0 END), 2) AS discount, round(100.0 * avg(CASE WHEN l_tax > 0 THEN 1 ELSE 0 END), 2) AS tax,
  round(100.0 * avg(CASE WHEN l_quantity >= 25 THEN 1 ELSE 0 END), 2) AS bulk FROM lineitem GROUP BY 1""")
def fill_rates(spark, sf_dir):
    conditions = {"discount": F.col("l_discount") > 0, "tax": F.col("l_tax") > 0, "bulk": F.col("l_quantity") >= 25}
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("source")).agg(*(F.round(100.0 * F.avg(c.cast("int")), 2).alias(k) for k, c in conditions.items()))


@query("A21", """
SELECT quality AS stage, count(*) FILTER (toxic = 1) AS yes, count(*) FILTER (toxic = 0) AS no, count(*) AS n, count(DISTINCT doc_id) AS texts FROM labels GROUP BY 1""")
def label_matrix(spark, sf_dir):
    return table(spark, sf_dir, "labels").groupBy(F.col("quality").alias("stage")).agg(F.count_if(F.col("toxic") == 1).alias("yes"), F.count_if(F.col("toxic") == 0).alias("no"), F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("texts"))


@query("A22", "SELECT count(*) AS total, count(*) FILTER (o_totalprice >= 200000) AS passed FROM orders")
def passed(spark, sf_dir):
    return agg.coverage(table(spark, sf_dir, "orders"), passed=F.col("o_totalprice") >= 200000)


def _observations(spark, sf_dir):
    """Price observations: role, grade, geo and format of each line, with its supplier as the owner."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.col("l_linestatus").alias("format"))
    part = table(spark, sf_dir, "part").select("p_partkey", F.split_part("p_type", F.lit(" "), F.lit(1)).alias("role"), F.col("p_brand").alias("grade"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("geo"))
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))


_OBSERVED = """o AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_extendedprice, split_part(p_type, ' ', 1) AS role, p_brand AS grade, s_nationkey AS geo
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""


@query("A23", """
WITH o AS (SELECT l_extendedprice, split_part(p_type, ' ', 1) AS role, p_brand AS grade, s_nationkey AS geo, l_linestatus AS format FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)
SELECT CASE WHEN grouping(format) = 0 THEN 1 WHEN grouping(geo) = 0 THEN 2 WHEN grouping(grade) = 0 THEN 3 ELSE 4 END AS level, role, grade, geo, format, count(*) AS n, round(quantile_cont(l_extendedprice, 0.25), 6) AS p25,
  round(quantile_cont(l_extendedprice, 0.5), 6) AS median, round(quantile_cont(l_extendedprice, 0.75), 6) AS p75
FROM o GROUP BY GROUPING SETS ((role, grade, geo, format), (role, grade, geo), (role, grade), (role))""")
def market_cells(spark, sf_dir):
    return agg.cascade_cells(_observations(spark, sf_dir), ["role", "grade", "geo", "format"], "l_extendedprice")


@query("A24", f"""
WITH {_OBSERVED},
w AS (SELECT *, count(*) OVER (PARTITION BY role, geo) AS size, row_number() OVER (PARTITION BY role, geo, l_suppkey ORDER BY l_orderkey, l_linenumber) AS place FROM o)
SELECT role, geo, count(*) AS n, count(DISTINCT l_suppkey) AS owners FROM w WHERE place <= greatest(1, floor(size * 0.2)) GROUP BY role, geo""")
def capped(spark, sf_dir):
    rows = agg.capped_per_group(_observations(spark, sf_dir), ["role", "geo"], "l_suppkey", ["l_orderkey", "l_linenumber"])
    return rows.groupBy("role", "geo").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_suppkey").alias("owners"))


@query("A25", "SELECT l_shipmode, p25, median, p75 FROM (SELECT l_returnflag AS l_shipmode, round(quantile_cont(l_extendedprice, 0.25), 6) AS p25, round(quantile_cont(l_extendedprice, 0.5), 6) AS median, round(quantile_cont(l_extendedprice, 0.75), 6) AS p75 FROM lineitem GROUP BY 1)")
def quartiles(spark, sf_dir):
    per = quantiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.25, 0.5, 0.75])
    return per.select(F.col("l_returnflag").alias("l_shipmode"), *(F.round(F.col("q")[i], 6).alias(k) for i, k in enumerate(("p25", "median", "p75"))))


@query("A26", "SELECT p_brand AS brand, round(avg(p_retailprice), 2) AS mean FROM part GROUP BY 1")
def means(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.round(F.avg("p_retailprice"), 2).alias("mean"))


@query("A27", "SELECT l_suppkey AS supplier, round(sum(l_extendedprice * l_discount) / nullif(sum(l_discount), 0), 2) AS mean FROM lineitem GROUP BY 1")
def weighted(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("supplier")).agg(F.round(agg.weighted_mean(F.col("l_extendedprice"), F.col("l_discount")), 2).alias("mean"))


@query("A28", """
WITH s AS (SELECT user_id, event_type, avg(value) AS m FROM events GROUP BY 1, 2)
SELECT user_id, arg_max(event_type, (m, event_type)) AS best, round(max(m), 8) AS top, CASE WHEN count(*) > 1 THEN round((sum(m) - max(m)) / (count(*) - 1), 8) END AS rest FROM s GROUP BY user_id""")
def best_site(spark, sf_dir):
    s = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("m"))
    rest = F.when(F.count(F.lit(1)) > 1, F.round((F.sum("m") - F.max("m")) / (F.count(F.lit(1)) - 1), 8))
    return s.groupBy("user_id").agg(F.max_by("event_type", F.struct("m", "event_type")).alias("best"), F.round(F.max("m"), 8).alias("top"), rest.alias("rest"))


@query("A29", "SELECT l_suppkey AS supplier, round(avg(CASE WHEN l_quantity <= 5 OR l_quantity >= 46 THEN 1 ELSE 0 END), 4) AS extremes, round(avg(CASE WHEN l_quantity BETWEEN 20 AND 30 THEN 1 ELSE 0 END), 4) AS middle FROM lineitem GROUP BY 1")
def bimodality(spark, sf_dir):
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("supplier")).agg(F.round(F.avg(((q <= 5) | (q >= 46)).cast("int")), 4).alias("extremes"), F.round(F.avg(q.between(20, 30).cast("int")), 4).alias("middle"))


@query("A30", "SELECT user_id, CASE WHEN count(*) >= 5 THEN round(count(*) FILTER (event_type = 'error') / count(*)::DOUBLE, 4) END AS share FROM events GROUP BY 1")
def supported_share(spark, sf_dir):
    n = F.count(F.lit(1))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.when(n >= 5, F.round(F.count_if(F.col("event_type") == "error") / n, 4)).alias("share"))


@query("A31", "SELECT c_nationkey AS area, count(*) AS n, count(*) FILTER (c_acctbal < 0) AS negative, round(avg(c_acctbal) FILTER (c_acctbal >= 0), 2) AS mean FROM customer GROUP BY 1")
def by_area(spark, sf_dir):
    bal = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("area")).agg(F.count(F.lit(1)).alias("n"), F.count_if(bal < 0).alias("negative"), F.round(F.avg(F.when(bal >= 0, bal)), 2).alias("mean"))


@query("A32", f"""
WITH {_OBSERVED}, m AS (SELECT role, quantile_cont(l_extendedprice, 0.5) AS med FROM o GROUP BY role),
d AS (SELECT l_suppkey, l_extendedprice / med - 1 AS dev FROM o JOIN m USING (role))
SELECT l_suppkey AS company, count(*) AS n, round(avg(CASE WHEN dev < -0.1 THEN 1 ELSE 0 END), 4) AS below, round(avg(CASE WHEN dev > 0.1 THEN 1 ELSE 0 END), 4) AS above, round(quantile_cont(dev, 0.5), 4) AS deviation FROM d GROUP BY 1""")
def company_mark(spark, sf_dir):
    o = written(_observations(spark, sf_dir).select("role", "l_suppkey", "l_extendedprice"))  # read twice
    medians_ = quantiles(o, ["role"], "l_extendedprice", [0.5]).select("role", F.col("q")[0].alias("med"))
    d = o.join(medians_, "role").select("l_suppkey", (F.col("l_extendedprice") / F.col("med") - 1).alias("dev"))
    d = written(d.select(F.col("l_suppkey").alias("company"), "dev"))  # read twice
    shares = d.groupBy("company").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("dev") < -0.1).cast("int")), 4).alias("below"), F.round(F.avg((F.col("dev") > 0.1).cast("int")), 4).alias("above"))
    middle = quantiles(d, ["company"], "dev", [0.5]).select("company", F.round(F.col("q")[0], 4).alias("deviation"))
    return shares.join(middle, "company", "left")


_WEIGHT_SQL = "CASE event_type WHEN 'error' THEN 3.0 WHEN 'purchase' THEN 2.0 WHEN 'signup' THEN 1.5 ELSE 0.5 END"


def _evidence(spark, sf_dir):
    weight = F.expr(_WEIGHT_SQL)
    months = F.datediff(F.to_date(now()), F.to_date("ts")) / 30
    return table(spark, sf_dir, "events").withColumns({"weight": weight.cast("double"), "months": months, "axis": F.when(F.col("event_type") == "error", "risk").otherwise("trust")})


@query("A34", f"""
SELECT user_id, CASE WHEN event_type = 'error' THEN 'risk' ELSE 'trust' END AS axis_name, count(*) AS n,
  round(10 * (1 - exp(-sum({_WEIGHT_SQL} * exp(-greatest(date_diff('day', CAST(ts AS DATE), DATE '{NOW[:10]}') / 30.0, 0) / 18)) / 6)), 4) AS axis FROM events GROUP BY 1, 2""")
def axes(spark, sf_dir):
    rows = _evidence(spark, sf_dir).withColumnRenamed("axis", "axis_name")
    return agg.decayed_axis(rows, ["user_id", "axis_name"], F.col("weight"), F.col("months"), 10.0)


@query("A36", """
SELECT user_id, count(*) AS n FROM (SELECT user_id, CAST(ts AS DATE) AS day, list(DISTINCT event_type) AS codes FROM events GROUP BY 1, 2) WHERE list_has_all(codes, ['error', 'purchase']) GROUP BY 1""")
def combos(spark, sf_dir):
    days = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.collect_set("event_type").alias("codes"))
    need = F.array(F.lit("error"), F.lit("purchase"))
    return days.filter(F.size(F.array_except(need, "codes")) == 0).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("A37_axes", f"""
WITH s AS (SELECT user_id, CASE WHEN event_type = 'error' THEN 'risk' ELSE 'trust' END AS axis,
    10 * (1 - exp(-sum({_WEIGHT_SQL} * exp(-greatest(date_diff('day', CAST(ts AS DATE), DATE '{NOW[:10]}') / 30.0, 0) / 18)) / 6)) AS x, count(*) AS n FROM events GROUP BY 1, 2),
p AS (SELECT user_id, coalesce(sum(x) FILTER (axis = 'risk'), 0) AS risk, coalesce(sum(x) FILTER (axis = 'trust'), 0) AS trust, sum(n)::BIGINT AS n FROM s GROUP BY 1)
SELECT user_id, round(risk - least(trust, 3), 4) AS score, CASE WHEN n < 5 THEN 'unknown' WHEN risk >= 9 THEN 'red' WHEN risk - least(trust, 3) >= 4 THEN 'yellow' ELSE 'green' END AS level FROM p""")
def whole_score(spark, sf_dir):
    rows = _evidence(spark, sf_dir)
    fade = F.sum(F.col("weight") * F.exp(-F.greatest(F.col("months"), F.lit(0.0)) / 18))
    s = rows.groupBy("user_id", "axis").agg((10 * (1 - F.exp(-fade / 6))).alias("x"), F.count(F.lit(1)).alias("n"))
    part = lambda a: F.coalesce(F.sum(F.when(F.col("axis") == a, F.col("x"))), F.lit(0.0))
    p = s.groupBy("user_id").agg(part("risk").alias("risk"), part("trust").alias("trust"), F.sum("n").alias("n"))
    score = F.col("risk") - F.least(F.col("trust"), F.lit(3.0))
    level = F.when(F.col("n") < 5, "unknown").when(F.col("risk") >= 9, "red").when(score >= 4, "yellow").otherwise("green")
    return p.select("user_id", F.round(score, 4).alias("score"), level.alias("level"))


@query("A39", "SELECT count(*) FILTER (l_discount >= 0.05 AND l_returnflag = 'R') AS tp, count(*) FILTER (l_discount >= 0.05 AND l_returnflag <> 'R') AS fp, count(*) FILTER (l_discount < 0.05 AND l_returnflag = 'R') AS fn, count(*) FILTER (l_discount < 0.05 AND l_returnflag <> 'R') AS tn FROM lineitem")
def confusion(spark, sf_dir):
    yes, one = F.col("l_discount") >= 0.05, F.col("l_returnflag") == "R"
    return table(spark, sf_dir, "lineitem").agg(F.count_if(yes & one).alias("tp"), F.count_if(yes & ~one).alias("fp"), F.count_if(~yes & one).alias("fn"), F.count_if(~yes & ~one).alias("tn"))


@query("A40", """
WITH s AS (SELECT l_quantity AS s, count(*) FILTER (l_returnflag = 'R') AS p, count(*) FILTER (l_returnflag <> 'R') AS n FROM lineitem GROUP BY 1),
b AS (SELECT p, n, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s)
SELECT round(sum(p * below + p * n * 0.5)::DOUBLE / nullif(sum(p)::DOUBLE * sum(n)::DOUBLE, 0), 6) AS auroc FROM b""")
def area(spark, sf_dir):
    return agg.auroc(table(spark, sf_dir, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("int")), "l_quantity", "y")


@query("A41", """
SELECT g.x AS "limit", count(*) FILTER (l_discount >= g.x AND l_returnflag = 'R') AS tp, count(*) FILTER (l_discount >= g.x AND l_returnflag <> 'R') AS fp,
  count(*) FILTER (l_discount < g.x AND l_returnflag = 'R') AS fn, count(*) FILTER (l_discount < g.x AND l_returnflag <> 'R') AS tn
FROM lineitem, (SELECT unnest([0.015, 0.035, 0.055, 0.075]::DOUBLE[]) AS x) g GROUP BY g.x""")
def grid(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    return agg.threshold_grid(rows, "l_discount", "y", [0.015, 0.035, 0.055, 0.075])


@query("A44", """
SELECT d.x AS delta, count(*) FILTER (o_totalprice >= 200000 - d.x) AS kept, count(*) FILTER (o_totalprice < 200000 - d.x AND o_orderpriority = '1-URGENT') AS lost
FROM orders, (SELECT unnest([0, 25000, 50000]) AS x) d GROUP BY d.x""")
def what_if(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_totalprice", "o_orderpriority", F.explode(F.array(F.lit(0), F.lit(25000), F.lit(50000))).alias("delta"))
    kept = F.col("o_totalprice") >= 200000 - F.col("delta")
    return rows.groupBy("delta").agg(F.count_if(kept).alias("kept"), F.count_if(~kept & (F.col("o_orderpriority") == "1-URGENT")).alias("lost"))


@query("A45", "SELECT station, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS station FROM part) WHERE station <> '' GROUP BY 1 ORDER BY n DESC, station LIMIT 40")
def stations(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("station")).filter("station <> ''").groupBy("station").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "station").limit(40)


@query("A46", """
WITH s AS (SELECT o_custkey AS person, unnest(range(year(o_orderdate) * 12 + month(o_orderdate) - 1, year(o_orderdate) * 12 + month(o_orderdate) + 2)) AS m FROM orders)
SELECT person, count(DISTINCT m) AS months FROM s GROUP BY 1""")
def union_months(spark, sf_dir):
    first = F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1
    s = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("person"), F.explode(F.sequence(first, first + 2)).alias("m"))
    return s.groupBy("person").agg(F.countDistinct("m").alias("months"))


@query("A49", "SELECT count(*) FILTER (quality = 0)::DOUBLE / nullif(count(*) FILTER (quality = 1), 0) AS weight FROM labels")
def balance(spark, sf_dir):
    y = F.col("quality")
    return table(spark, sf_dir, "labels").agg((F.count_if(y == 0) / F.nullif(F.count_if(y == 1), F.lit(0))).alias("weight"))


@query("A50", "SELECT label, len(embedding)::INT AS dim, count(*) AS n FROM embeddings GROUP BY 1, 2")
def vector_counts(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").groupBy("label", F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n"))


@query("A51", "SELECT n_name AS name FROM nation UNION SELECT r_name FROM region")
def names(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")).union(table(spark, sf_dir, "region").select("r_name")).distinct()


@query("A52", "SELECT o_custkey AS owner, max(o_orderkey) + 1 AS next FROM orders GROUP BY 1")
def next_position(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("owner")).agg((F.max("o_orderkey") + 1).alias("next"))


# Windows -------------------------------------------------------------------------------------------------------------


def _active():
    return F.col("event_type") != "error"


@query("N1", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1")
def last_rows(spark, sf_dir):
    return hist.last_state(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type", "value")


@query("N2", """
WITH l AS (SELECT user_id, event_type <> 'error' AS a, lag(event_type <> 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)
SELECT user_id, 1 + count(*) FILTER (a AND NOT b) AS cycles FROM l GROUP BY 1""")
def reopened(spark, sf_dir):
    return hist.cycles(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], _active())


@query("N3", """
WITH l AS (SELECT user_id, event_type, lag(event_type) OVER w AS b, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, count(*) FILTER (n > 1 AND event_type IS DISTINCT FROM b) AS changes FROM l GROUP BY 1""")
def changed(spark, sf_dir):
    return hist.changes(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type"))


@query("N4", "SELECT user_id, (epoch(max(ts)) - epoch(min(ts)))::BIGINT // 86400 AS days FROM events GROUP BY 1")
def spans(spark, sf_dir):
    return hist.span_days(table(spark, sf_dir, "events"), "user_id", "ts")


@query("N5", """
WITH l AS (SELECT user_id, ts, props, event_type <> 'error' AS a, lag(event_type <> 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)
SELECT user_id, greatest(count(DISTINCT CAST(ts AS DATE)), count(DISTINCT props), 1 + count(*) FILTER (a AND NOT b)) AS republished FROM l GROUP BY 1""")
def republished(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    marked = e.withColumn("a", _active()).withColumn("b", F.lag("a").over(w))
    return marked.groupBy("user_id").agg(F.greatest(F.countDistinct(F.to_date("ts")), F.countDistinct("props"), 1 + F.count_if(F.col("a") & ~F.col("b"))).alias("republished"))


@query("N6", """
WITH d AS (SELECT event_id, user_id, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS day FROM events WHERE event_type = 'purchase'),
s AS (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY day RANGE BETWEEN CURRENT ROW AND 6 FOLLOWING) >= 3 AS st FROM d)
SELECT event_id, user_id, max(st::INT) OVER (PARTITION BY user_id ORDER BY day RANGE BETWEEN 6 PRECEDING AND CURRENT ROW) = 1 AS hot FROM s""")
def hot_weeks(spark, sf_dir):
    d = table(spark, sf_dir, "events").filter("event_type = 'purchase'").select("event_id", "user_id", F.unix_date(F.to_date("ts")).alias("day"))
    return hist.bursts(d, "user_id", "day").select("event_id", "user_id", "hot")


@query("N8", """
WITH s AS (SELECT event_id, user_id, event_type, value >= 90 AS sig, avg((value >= 90)::INT) OVER (PARTITION BY user_id) AS share, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT event_id, sig AND NOT (n >= 8 AND share > 0.5) AS signal FROM s""")
def thinned(spark, sf_dir):
    w = Window.partitionBy("user_id")
    s = table(spark, sf_dir, "events").withColumn("sig", F.col("value") >= 90)
    crowd = (F.count(F.lit(1)).over(w) >= 8) & (F.avg(F.col("sig").cast("int")).over(w) > 0.5)
    return s.select("event_id", (F.col("sig") & ~crowd).alias("signal"))


@query("N9", "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 8")
def per_source(spark, sf_dir):
    return hist.quota(table(spark, sf_dir, "documents").select("doc_id", "source"), ["source"], ["doc_id"], 8)


@query("N10", """
SELECT o_orderpriority AS code, o_orderkey AS key, price FROM (SELECT o_orderpriority, o_orderkey, o_totalprice AS price, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders)
WHERE r = 1 ORDER BY price DESC, code LIMIT 3""")
def top_codes(spark, sf_dir):
    best = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("code")).agg(F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_totalprice", -F.col("o_orderkey"))).alias("s"))
    return best.select("code", F.col("s.o_orderkey").alias("key"), F.col("s.o_totalprice").alias("price")).orderBy(F.desc("price"), "code").limit(3)


@query("N11", "SELECT md5(text) AS h, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def first_seen(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.md5(F.col("text").cast("binary")).alias("h")).agg(F.min("doc_id").alias("doc_id"))


@query("N13", """
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER w AS r, lead(n) OVER w AS second FROM c WINDOW w AS (PARTITION BY user_id ORDER BY n DESC, event_type))
SELECT user_id, CASE WHEN n - coalesce(second, 0) >= 2 THEN event_type ELSE 'unknown' END AS area, n FROM r WHERE r = 1""")
def argmax_margin(spark, sf_dir):
    c = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("user_id").orderBy(F.desc("n"), "event_type")
    r = c.withColumn("r", F.row_number().over(w)).withColumn("second", F.lead("n").over(w)).filter("r = 1")
    return r.select("user_id", F.when(F.col("n") - F.coalesce("second", F.lit(0)) >= 2, F.col("event_type")).otherwise("unknown").alias("area"), "n")


@query("N14", "SELECT l_partkey AS part, arg_max(l_suppkey, (l_extendedprice, l_suppkey)) AS supplier, max(l_extendedprice) AS price FROM lineitem GROUP BY 1")
def best_per_key(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(F.max_by("l_suppkey", F.struct("l_extendedprice", "l_suppkey")).alias("supplier"), F.max("l_extendedprice").alias("price"))


@query("N15", "SELECT event_id, value FROM events ORDER BY abs(value / 100 - 0.5) NULLS LAST, event_id LIMIT 50")
def most_doubtful(spark, sf_dir):
    return table(spark, sf_dir, "events").orderBy(F.abs(F.col("value") / 100 - 0.5).asc_nulls_last(), "event_id").select("event_id", "value").limit(50)
