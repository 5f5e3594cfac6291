"""Queries of joins, predicates, sorts, sets and merges: ids J, P, L, U and W of the operator inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.operators import filters as flt
from attesta.operators import history as hist
from attesta.operators import similar, vector_index
from attesta.plans.registry import query
from attesta.streaming.events import written
from attesta.sources.tables import NOW, now, table


@query("J1", "SELECT c_mktsegment AS segment, count(*) AS n, round(avg(o_totalprice), 2) AS mean FROM orders JOIN customer ON o_custkey = c_custkey AND c_mktsegment = 'BUILDING' GROUP BY 1")
def scoped(spark, sf_dir):
    profile = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'")
    rows = table(spark, sf_dir, "orders").join(profile, F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 2).alias("mean"))


@query("J2", "SELECT n_name AS nation, l_returnflag AS flag, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2")
def three_way(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey").join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.groupBy(F.col("n_name").alias("nation"), F.col("l_returnflag").alias("flag")).agg(F.count(F.lit(1)).alias("n"))


@query("J3", "SELECT o_orderkey AS key, count(*) AS lines FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def linked(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey").join(table(spark, sf_dir, "lineitem").select("l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.groupBy(F.col("o_orderkey").alias("key")).agg(F.count(F.lit(1)).alias("lines"))


@query("J4", "SELECT c_custkey AS company, coalesce(level, 'unknown') AS level FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderpriority) AS level FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def with_level(spark, sf_dir):
    level = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderpriority").alias("level"))
    return table(spark, sf_dir, "customer").join(level, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_custkey").alias("company"), F.coalesce("level", F.lit("unknown")).alias("level"))


@query("J5", "SELECT event_id, c_name AS company FROM events LEFT JOIN customer ON user_id = c_custkey AND event_type = 'purchase'")
def left_predicate(spark, sf_dir):
    on = (F.col("user_id") == F.col("c_custkey")) & (F.col("event_type") == "purchase")
    return table(spark, sf_dir, "events").join(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), on, "left").select("event_id", F.col("c_name").alias("company"))


@query("J6", "SELECT o_orderkey AS key FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey IS NOT NULL)")
def orphans(spark, sf_dir):
    back = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(back, "o_orderkey", "left_anti").select(F.col("o_orderkey").alias("key"))


@query("J10", """
SELECT c_custkey AS company, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') OR EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey AND event_type = 'error') AS flagged FROM customer""")
def exists_or(spark, sf_dir):
    opened = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("a", F.lit(True))
    errors = table(spark, sf_dir, "events").filter("event_type = 'error'").select(F.col("user_id").alias("c_custkey")).distinct().withColumn("b", F.lit(True))
    rows = table(spark, sf_dir, "customer").join(opened, "c_custkey", "left").join(errors, "c_custkey", "left")
    return rows.select(F.col("c_custkey").alias("company"), (F.coalesce("a", F.lit(False)) | F.coalesce("b", F.lit(False))).alias("flagged"))


@query("J11", "SELECT c_custkey AS company FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000 AND o_orderpriority = '1-URGENT')")
def exists_several(spark, sf_dir):
    want = table(spark, sf_dir, "orders").filter("o_totalprice > 300000 AND o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(want, "c_custkey", "left_semi").select(F.col("c_custkey").alias("company"))


@query("J12", "SELECT event_id FROM events a WHERE event_type = 'click' AND NOT EXISTS (SELECT 1 FROM events b WHERE b.event_type = 'purchase' AND b.user_id = a.user_id AND CAST(b.ts AS DATE) = CAST(a.ts AS DATE))")
def unconfirmed(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return e.filter("event_type = 'click'").join(e.filter("event_type = 'purchase'").select("user_id", "day"), ["user_id", "day"], "left_anti").select("event_id")


@query("J13", "SELECT o_orderkey AS key FROM orders a WHERE NOT EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderdate > a.o_orderdate)")
def none_newer(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    newest = o.groupBy("o_custkey").agg(F.max("o_orderdate").alias("newest"))  # a theta anti-join, as a grouped maximum
    return o.join(newest, "o_custkey").filter(F.col("o_orderdate") >= F.col("newest")).select(F.col("o_orderkey").alias("key"))


@query("J14", "SELECT c_custkey AS company, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS openings FROM customer")
def scalar_count(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("openings"))
    return table(spark, sf_dir, "customer").join(n, "c_custkey", "left").select(F.col("c_custkey").alias("company"), F.coalesce("openings", F.lit(0)).alias("openings"))


@query("J15", "SELECT c_custkey AS company, last FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS last FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def latest_status(spark, sf_dir):
    last = hist.last_state(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderstatus")
    return table(spark, sf_dir, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_custkey").alias("company"), F.col("o_orderstatus").alias("last"))


@query("J16", "SELECT c_custkey AS company, coalesce(k, 0) AS k FROM customer LEFT JOIN (SELECT user_id, greatest(count(DISTINCT event_type), count(DISTINCT CAST(ts AS DATE))) AS k FROM events GROUP BY 1) ON c_custkey = user_id")
def greatest_counts(spark, sf_dir):
    k = table(spark, sf_dir, "events").groupBy("user_id").agg(F.greatest(F.countDistinct("event_type"), F.countDistinct(F.to_date("ts"))).alias("k"))
    return table(spark, sf_dir, "customer").join(k, F.col("c_custkey") == F.col("user_id"), "left").select(F.col("c_custkey").alias("company"), F.coalesce("k", F.lit(0)).alias("k"))


@query("J17", r"""
WITH h AS (SELECT doc_id, source, sha1(array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), ' ')) AS h FROM documents)
SELECT doc_id FROM h WHERE h IN (SELECT h FROM h GROUP BY h HAVING count(DISTINCT source) > 1)""")
def copied_elsewhere(spark, sf_dir):
    from attesta.functions.text import text_hash

    h = written(table(spark, sf_dir, "documents").select("doc_id", "source", text_hash(F.col("text")).alias("h")))  # read twice
    return h.join(similar.shared_elsewhere(h, "h", "source"), "h", "left_semi").select("doc_id")


@query("J18", r"""
WITH w AS (SELECT doc_id, source, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents),
s AS (SELECT doc_id, source, CASE WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))) END AS s FROM w WHERE len(w) > 0),
r AS MATERIALIZED (SELECT source, s, min(doc_id) AS doc_id, len(s) AS n FROM s GROUP BY source, s),
g AS (SELECT source, doc_id, n, unnest(s) AS g FROM r), p AS (SELECT a.doc_id AS x, b.doc_id AS y, least(any_value(a.n), any_value(b.n)) AS n, count(*) AS c FROM g a JOIN g b ON a.source = b.source AND a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL)
SELECT x AS a, y AS b, round(c / n::DOUBLE, 4) AS similarity FROM p WHERE round(c / n::DOUBLE, 4) >= 0.6 UNION ALL SELECT r.doc_id, s.doc_id, 1.0 FROM s JOIN r ON s.source = r.source AND s.s = r.s WHERE s.doc_id <> r.doc_id""")
def contained(spark, sf_dir):
    return similar.containment_pairs(table(spark, sf_dir, "documents"), "doc_id", "source", "text")


@query("J19", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.4")
def near_vectors(spark, sf_dir):
    return vector_index.near_pairs(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.4)


_NEAREST_SQL = """
q AS (SELECT vec_id AS q, embedding AS e FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT q, vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]), 6) AS cosine FROM embeddings JOIN q ON vec_id <> q),
n AS (SELECT q, id, cosine FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY cosine DESC, id) AS r FROM s) WHERE r <= 10)"""


def _stated(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e, e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv"))


@query("J20_every_50th", f"WITH {_NEAREST_SQL} SELECT q, id, cosine FROM n")
@query("J20", f"WITH {_NEAREST_SQL} SELECT q, id, cosine FROM n")
def nearest(spark, sf_dir):
    """The ten most similar vectors of every one whose id is divisible by 50, exactly."""
    e, stated = _stated(spark, sf_dir)
    return similar.most_similar(e, "vec_id", "embedding", stated, 10)


@query("J20_index", f"WITH {_NEAREST_SQL} SELECT count(*) AS wanted, true AS recalled FROM n")
def nearest_by_index(spark, sf_dir):
    """The same by an inverted file over all vectors, and whether it finds nine in ten of the exact neighbours."""
    e, stated = _stated(spark, sf_dir)
    found = vector_index.search(vector_index.build(e, "vec_id", "embedding"), stated, 10).select("q", "id", F.lit(1).alias("hit"))
    both = similar.most_similar(e, "vec_id", "embedding", stated, 10).join(found, ["q", "id"], "left")
    return both.agg(F.count(F.lit(1)).alias("wanted"), (F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("recalled"))


@query("J24", """
WITH o AS MATERIALIZED (SELECT split_part(p_type, ' ', 1) AS role, p_brand AS grade, l_suppkey AS owner, l_extendedprice AS x FROM lineitem JOIN part ON l_partkey = p_partkey),
c AS MATERIALIZED (SELECT role, grade, owner, count(*) AS n, quantile_cont(x, 0.5) AS med FROM o GROUP BY GROUPING SETS ((role, grade, owner), (role, grade), (role))),
k AS MATERIALIZED (SELECT DISTINCT role, grade, owner FROM o)
SELECT k.role, k.grade, k.owner, round(CASE WHEN a.n >= 8 THEN a.med WHEN b.n >= 8 THEN b.med ELSE d.med END, 6) AS median, CASE WHEN a.n >= 8 THEN 1 WHEN b.n >= 8 THEN 2 ELSE 3 END AS level
FROM k JOIN c a ON a.role = k.role AND a.grade = k.grade AND a.owner = k.owner JOIN c b ON b.role = k.role AND b.grade = k.grade AND b.owner IS NULL JOIN c d ON d.role = k.role AND d.grade IS NULL""")
def cascade_lookup(spark, sf_dir):
    from attesta.operators.aggregates import cascade_cells

    part = table(spark, sf_dir, "part").select("p_partkey", F.split_part("p_type", F.lit(" "), F.lit(1)).alias("role"), F.col("p_brand").alias("grade"))
    o = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_suppkey").alias("owner"), "l_extendedprice").join(part, F.col("l_partkey") == F.col("p_partkey"))
    cells = written(cascade_cells(o, ["role", "grade", "owner"], "l_extendedprice"))  # read three times
    own = cells.filter("level = 1").select("role", "grade", "owner", F.col("n").alias("n1"), F.col("median").alias("m1"))
    mid = cells.filter("level = 2").select("role", "grade", F.col("n").alias("n2"), F.col("median").alias("m2"))
    top = cells.filter("level = 3").select("role", F.col("median").alias("m3"))
    few = lambda cells: F.broadcast(cells) if cells.count() <= 100_000 else cells  # noqa: E731  # a shuffle by few keys gives few, large tasks
    rows = own.join(few(mid), ["role", "grade"]).join(few(top), "role")
    pick = F.when(F.col("n1") >= 8, F.lit(1)).when(F.col("n2") >= 8, F.lit(2)).otherwise(F.lit(3))
    return rows.select("role", "grade", "owner", F.when(pick == 1, F.col("m1")).when(pick == 2, F.col("m2")).otherwise(F.col("m3")).alias("median"), pick.alias("level"))


@query("J25", """
WITH d AS (SELECT event_id, user_id, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS day FROM events)
SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY day RANGE BETWEEN CURRENT ROW AND 6 FOLLOWING) AS week FROM d""")
def within_week(spark, sf_dir):
    from pyspark.sql import Window

    d = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_date(F.to_date("ts")).alias("day"))
    return d.select("event_id", F.count(F.lit(1)).over(Window.partitionBy("user_id").orderBy("day").rangeBetween(0, 6)).alias("week"))


@query("J28", "SELECT n_name AS name, list_sort(list(DISTINCT owner)) AS owners FROM (SELECT n_name, 'customer' AS owner FROM nation JOIN customer ON c_nationkey = n_nationkey UNION ALL SELECT n_name, 'supplier' FROM nation JOIN supplier ON s_nationkey = n_nationkey) GROUP BY 1")
def merged_owners(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    of = lambda t, k, name: table(spark, sf_dir, t).select(F.col(k).alias("n_nationkey")).distinct().withColumn("owner", F.lit(name))
    both = of("customer", "c_nationkey", "customer").unionByName(of("supplier", "s_nationkey", "supplier"))
    return n.join(both, "n_nationkey").groupBy(F.col("n_name").alias("name")).agg(F.sort_array(F.collect_set("owner")).alias("owners"))


@query("J29", "SELECT lower(trim(event_type)) AS request, list_sort(list(DISTINCT user_id)) AS owners FROM events WHERE event_type = 'signup' GROUP BY 1")
def shared_requests(spark, sf_dir):
    rows = table(spark, sf_dir, "events").filter("event_type = 'signup'")
    return rows.groupBy(F.lower(F.trim("event_type")).alias("request")).agg(F.sort_array(F.collect_set("user_id")).alias("owners"))


@query("J30", """
SELECT user_id, day, event_type FROM (SELECT user_id, CAST(ts AS DATE) AS day, event_type, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY (event_type = 'purchase') DESC, event_id) AS r FROM events) WHERE r = 1""")
def priority_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    best = rows.groupBy("user_id", "day").agg(F.max_by("event_type", F.struct((F.col("event_type") == "purchase").cast("int"), -F.col("event_id"))).alias("event_type"))
    return best


# Predicates ----------------------------------------------------------------------------------------------------------


def _catalogue() -> dict[str, flt.Filter]:
    return {
        "q": flt.contains("o_orderpriority"),
        "min_price": flt.number(lambda x: F.coalesce("o_totalprice", F.lit(0.0)) >= x),
        "days": flt.number(lambda x: F.col("o_orderdate") >= F.lit("1998-08-02").cast("timestamp") - F.make_interval(days=F.lit(int(min(3650, max(0, x)))))),
        "state": flt.choice({"open": F.col("o_orderstatus") == "O", "closed": F.col("o_orderstatus") == "F"}),
    }


@query("P1", "SELECT o_orderkey AS key FROM orders WHERE coalesce(o_totalprice, 0) >= 150000 AND o_orderstatus = 'O' AND contains(lower(o_orderpriority), 'urgent')")
def catalogue(spark, sf_dir):
    where, _ = flt.build(_catalogue(), {"q": "Urgent", "min_price": "150000", "state": "open", "days": "many", "unknown": "1"})
    return table(spark, sf_dir, "orders").filter(where).select(F.col("o_orderkey").alias("key"))


@query("P3", "SELECT o_orderkey AS key, o_totalprice AS price FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25")
def whitelisted_sort(spark, sf_dir):
    sorts = {"price": [F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey")], "date": [F.col("o_orderdate"), F.col("o_orderkey")]}
    return table(spark, sf_dir, "orders").orderBy(*flt.order(sorts, "no such sort", "price")).select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price")).limit(25)


@query("P5", "SELECT p_partkey AS part FROM part WHERE contains(lower(p_type), 'econ')")
def substring(spark, sf_dir):
    return table(spark, sf_dir, "part").filter(flt.contains("p_type")("ECON")).select(F.col("p_partkey").alias("part"))


@query("P10", f"SELECT event_type, count(*) AS n FROM events WHERE CAST(ts AS DATE) >= DATE '{NOW[:10]}' - 10 GROUP BY 1")
def days_ago(spark, sf_dir):
    return table(spark, sf_dir, "events").filter(F.to_date("ts") >= F.date_sub(F.to_date(now()), 10)).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("P12", "SELECT doc_id FROM documents WHERE nullif(trim(text), '') IS NOT NULL AND source <> '[]'")
def not_blank(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter((F.nullif(F.trim("text"), F.lit("")).isNotNull()) & (F.col("source") != "[]")).select("doc_id")


@query("P13", r"""
SELECT doc_id FROM documents WHERE len(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda w: starts_with(w, 'idio') OR starts_with(w, 'lose'))) > 0 OR contains(lower(text), 'all rights reserved')""")
def stop_words(spark, sf_dir):
    from attesta.functions.text import words

    stems, phrases = ["idio", "lose"], ["all rights reserved"]
    hit = F.exists(words(F.col("text")), lambda w: w.startswith(stems[0]) | w.startswith(stems[1]))
    for p in phrases:
        hit = hit | F.contains(F.lower("text"), F.lit(p))
    return table(spark, sf_dir, "documents").filter(hit).select("doc_id")


@query("P14", "SELECT o_orderkey AS key, round(o_totalprice / 5000 + 20, 8) AS ceiling FROM orders WHERE o_totalprice / 5000 + 20 >= 80")
def ceiling(spark, sf_dir):
    top = F.col("o_totalprice") / 5000 + 20
    return table(spark, sf_dir, "orders").filter(top >= 80).select(F.col("o_orderkey").alias("key"), F.round(top, 8).alias("ceiling"))


@query("P18", "SELECT event_id, CASE WHEN value / 100 >= 0.8 THEN 'yes' WHEN value / 100 <= 0.2 THEN 'no' ELSE 'undecided' END AS verdict FROM events")
def decide(spark, sf_dir):
    p = F.col("value") / 100
    return table(spark, sf_dir, "events").select("event_id", F.when(p >= 0.8, "yes").when(p <= 0.2, "no").otherwise("undecided").alias("verdict"))


@query("P21", f"SELECT user_id, event_type FROM events GROUP BY ALL HAVING max(ts) < TIMESTAMP '{NOW}' - INTERVAL 72 HOUR")
def due(spark, sf_dir):
    """What is watched, an event's kind of a user, and was last seen more than 72 hours ago."""
    last = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("ts").alias("last"))
    return last.filter(F.coalesce("last", F.lit("1970-01-01").cast("timestamp")) < now() - F.expr("INTERVAL 72 HOURS")).select("user_id", "event_type")


@query("P25", f"SELECT user_id, date_diff('day', max(CAST(ts AS DATE)), DATE '{NOW[:10]}') <= 3 AS fresh FROM events GROUP BY 1")
def fresh(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg((F.datediff(F.to_date(now()), F.max(F.to_date("ts"))) <= 3).alias("fresh"))


# Sorts and limits ----------------------------------------------------------------------------------------------------


@query("L1", "SELECT o_orderkey AS key, o_totalprice AS price, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS total FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def page(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'")
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price")).join(F.broadcast(total))  # one row


@query("L3", "SELECT o_orderkey AS key FROM orders ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey LIMIT 30")
def case_rank(spark, sf_dir):
    rank = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return table(spark, sf_dir, "orders").orderBy(rank, F.desc("o_totalprice"), "o_orderkey").limit(30).select(F.col("o_orderkey").alias("key"))


@query("L8", "SELECT l_orderkey AS key, l_linenumber AS line FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag, l_quantity DESC, l_extendedprice DESC, l_linenumber) AS r FROM lineitem) WHERE r <= 3")
def ranked_candidates(spark, sf_dir):
    order = ["l_returnflag", F.desc("l_quantity"), F.desc("l_extendedprice"), "l_linenumber"]
    return hist.quota(table(spark, sf_dir, "lineitem"), ["l_orderkey"], order, 3).select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("line"))


@query("L10", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 15")
def latest_rows(spark, sf_dir):
    return table(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(15).select("event_id", "event_type")


# Sets and merges -----------------------------------------------------------------------------------------------------


def _halves(spark, sf_dir):
    """Counts per user and type in the first and second half of the period: an old and a new table."""
    e = table(spark, sf_dir, "events").withColumn("late", F.col("ts") >= F.lit("2024-01-16").cast("timestamp"))
    rows = e.groupBy("user_id", "event_type", "late").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("at"))
    return rows.filter("not late").drop("late"), rows.filter("late").drop("late")


_HALVES = "h AS (SELECT user_id, event_type, ts >= TIMESTAMP '2024-01-16' AS late, count(*) AS n, max(ts) AS at FROM events GROUP BY 1, 2, 3), a AS (SELECT * FROM h WHERE NOT late), b AS (SELECT * FROM h WHERE late)"


@query("U2", """
WITH k AS (SELECT user_id, json_extract_string(props, '$.k') AS k, arg_max(event_type, (ts, event_id)) AS last, max(ts) AS seen_at FROM events GROUP BY ALL)
SELECT user_id, k FROM k WHERE seen_at < TIMESTAMP '2024-01-28' AND last <> 'error'""")
def gone(spark, sf_dir):
    """Known keys, less those seen in the last run, less those already inactive."""
    e = table(spark, sf_dir, "events").select("user_id", F.get_json_object("props", "$.k").alias("k"), "event_type", "ts", "event_id")
    states = e.groupBy("user_id", "k").agg((F.max_by("event_type", F.struct("ts", "event_id")) != "error").alias("active"))
    seen = e.filter(F.col("ts") >= F.lit("2024-01-28").cast("timestamp")).select("user_id", "k").distinct()
    return states.filter("active").select("user_id", "k").join(seen, ["user_id", "k"], "left_anti")


@query("U3", "SELECT p_partkey AS part FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)")
def missing(spark, sf_dir):
    known = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' and l_quantity > 45").select(F.col("l_partkey").alias("part"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part")).join(known, "part", "left_anti")


@query("U4", "SELECT user_id FROM (SELECT user_id FROM events WHERE event_type = 'purchase' INTERSECT SELECT user_id FROM events WHERE event_type = 'error')")
def both_sets(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.filter("event_type = 'purchase'").select("user_id").intersect(e.filter("event_type = 'error'").select("user_id"))


@query("U5", "SELECT kind, count(*) AS n FROM (SELECT 'order' AS kind, o_orderkey AS id FROM orders UNION ALL SELECT 'event', event_id FROM events UNION ALL SELECT 'label', doc_id FROM labels) GROUP BY 1")
def bag_union(spark, sf_dir):
    one = lambda t, c, k: table(spark, sf_dir, t).select(F.lit(k).alias("kind"), F.col(c).alias("id"))
    return one("orders", "o_orderkey", "order").unionByName(one("events", "event_id", "event")).unionByName(one("labels", "doc_id", "label")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("W1", f"WITH {_HALVES} SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.event_type, b.event_type) AS event_type, coalesce(a.n, b.n) AS n, coalesce(b.at, a.at) AS at, a.user_id IS NULL AS is_new FROM a FULL JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type")
def upsert_keeping(spark, sf_dir):
    old, new = _halves(spark, sf_dir)
    return hist.merge_keep_old(old, new, ["user_id", "event_type"], ["n"])


@query("W2", f"WITH {_HALVES} SELECT coalesce(b.user_id, a.user_id) AS user_id, coalesce(b.event_type, a.event_type) AS event_type, coalesce(b.n, a.n) AS n, coalesce(b.at, a.at) AS at FROM a FULL JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type")
def upsert_last(spark, sf_dir):
    old, new = _halves(spark, sf_dir)
    return hist.latest_wins(old, new, ["user_id", "event_type"], "at")


@query("W3", "SELECT user_id, count(*) AS pages, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1")
def accumulated(spark, sf_dir):
    old, new = _halves(spark, sf_dir)
    counters = old.unionByName(new)
    return counters.groupBy("user_id").agg(F.sum("n").alias("pages"), F.coalesce(F.sum(F.when(F.col("event_type") == "error", F.col("n"))), F.lit(0)).alias("failed"))


@query("W5", f"WITH {_HALVES} SELECT user_id, event_type, n FROM a UNION ALL SELECT user_id, event_type, n FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.user_id = b.user_id AND a.event_type = b.event_type)")
def first_wins(spark, sf_dir):
    old, new = _halves(spark, sf_dir)
    return hist.insert_absent(old, new, ["user_id", "event_type"]).select("user_id", "event_type", "n")


@query("W7", f"WITH {_HALVES} SELECT user_id, event_type, n FROM a WHERE user_id NOT IN (SELECT user_id FROM b) UNION ALL SELECT user_id, event_type, n FROM b")
def replaced(spark, sf_dir):
    old, new = _halves(spark, sf_dir)
    return hist.replace_groups(old, new, ["user_id"]).select("user_id", "event_type", "n")


@query("W9", f"WITH {_HALVES} SELECT user_id, event_type, NOT EXISTS (SELECT 1 FROM a WHERE a.user_id = b.user_id AND a.event_type = b.event_type) AS fresh FROM b")
def first_link(spark, sf_dir):
    old, new = _halves(spark, sf_dir)
    known = old.select("user_id", "event_type").withColumn("known", F.lit(True))
    return new.join(known, ["user_id", "event_type"], "left").select("user_id", "event_type", F.col("known").isNull().alias("fresh"))


@query("W10", "SELECT o_orderkey AS key, CASE WHEN o_orderpriority = '5-LOW' THEN 'skip' ELSE o_orderstatus END AS status FROM orders")
def bulk_update(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.when(F.col("o_orderpriority") == "5-LOW", "skip").otherwise(F.col("o_orderstatus")).alias("status"))


@query("W12", f"SELECT event_id FROM events WHERE date_diff('day', CAST(ts AS DATE), DATE '{NOW[:10]}') BETWEEN 0 AND 15")
def retained(spark, sf_dir):
    return table(spark, sf_dir, "events").filter(F.datediff(F.to_date(now()), F.to_date("ts")).between(0, 15)).select("event_id")
