"""Queries of record assembly: merges, lookups, filters, orders, counts and evidence rows that the other modules leave open."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attesta.operators import filters as flt
from attesta.operators import history as hist
from attesta.plans.registry import query
from attesta.sources.tables import NOW, now, table
from attesta.streaming.events import shared

MARKERS = ("data", "time", "people")


@query("W4", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 OR c_custkey % 5 = 0 THEN c_name ELSE 'new ' || c_name END AS c_name FROM customer")
def keep_old_when_blank(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    new = old.filter("c_custkey % 5 <> 0").withColumn("c_name", F.when(F.col("c_custkey") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("new "), "c_name")))
    return hist.fill_empty(old, new, ["c_custkey"], "c_name").select("c_custkey", "c_name")


@query("W6", "SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 0.0::DOUBLE ELSE s_acctbal END AS s_acctbal FROM supplier")
def replace_rows(spark, sf_dir):
    old = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    new = old.filter("s_suppkey % 4 = 0").withColumn("s_acctbal", F.lit(0.0))
    return old.join(new, "s_suppkey", "left_anti").unionByName(new)


@query("W8", "SELECT event_type, 2 * count(*) AS n FROM events GROUP BY 1")
def append_snapshots(spark, sf_dir):
    path = f"{shared(spark)}/snapshots-{uuid.uuid4().hex}"
    for _ in range(2):
        table(spark, sf_dir, "events").select("event_id", "event_type").write.mode("append").parquet(path)
    return spark.read.parquet(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("W13", "SELECT lang, count(*) AS n FROM documents WHERE lang = 'en' GROUP BY 1")
def drop_other_partitions(spark, sf_dir):
    path = f"{shared(spark)}/models-{uuid.uuid4().hex}"
    table(spark, sf_dir, "documents").select("doc_id", "lang").write.partitionBy("lang").parquet(path)
    return spark.read.schema("doc_id long, lang string").parquet(path).filter("lang = 'en'").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("J7", "SELECT o_orderkey AS key, c_acctbal AS score FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def map_colour(spark, sf_dir):
    scored = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_acctbal").alias("score"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(scored, "o_custkey", "left").select(F.col("o_orderkey").alias("key"), "score")


@query("J8", "SELECT l_orderkey AS key, l_linenumber AS field, o_orderstatus AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity >= 45")
def conditions_of(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").filter("l_quantity >= 45").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("field"))
    return lines.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("value")), "key")


@query("J9", "SELECT d.doc_id, quality, toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def signals_of(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "quality", "toxic")


def _even_lengths(spark, sf_dir):
    """(source, n_chars, partners): how many of a source have 90 to 100 % of the length.

    Rows are first counted by length; lengths then meet in bands a factor 10/9 wide, so no band joins with more than two.
    """
    counts = table(spark, sf_dir, "documents").filter("n_chars > 0").groupBy("source", "n_chars").agg(F.count(F.lit(1)).alias("c"))
    band = F.floor(F.log(F.col("n_chars").cast("double")) / F.log(F.lit(10 / 9)))
    anchors = counts.select("source", "n_chars", "c", F.explode(F.array(band - 1, band)).alias("band"))
    other = counts.select("source", F.col("n_chars").alias("m"), F.col("c").alias("d"), band.alias("band"))
    near = (F.col("m") <= F.col("n_chars")) & (10 * (F.col("n_chars") - F.col("m")) <= F.col("n_chars"))
    return anchors.join(other, ["source", "band"]).filter(near).groupBy("source", "n_chars", "c").agg((F.sum("d") - 1).alias("partners"))


EVEN_SQL = """
SELECT a.source, a.n_chars, any_value(a.c) AS c, (sum(b.c) - 1)::BIGINT AS partners FROM (SELECT source, n_chars, count(*) AS c FROM documents WHERE n_chars > 0 GROUP BY ALL) a
JOIN (SELECT source, n_chars, count(*) AS c FROM documents WHERE n_chars > 0 GROUP BY ALL) b
ON a.source = b.source AND b.n_chars <= a.n_chars AND 10 * (a.n_chars - b.n_chars) <= a.n_chars GROUP BY a.source, a.n_chars"""


@query("J26", f"SELECT source, n_chars, partners FROM ({EVEN_SQL})")
def length_range_pairs(spark, sf_dir):
    return _even_lengths(spark, sf_dir).select("source", "n_chars", "partners")


@query("N7", f"SELECT source, sum(c)::BIGINT AS anchors FROM ({EVEN_SQL}) WHERE partners >= 2 GROUP BY 1")
def even_groups(spark, sf_dir):
    return _even_lengths(spark, sf_dir).filter("partners >= 2").groupBy("source").agg(F.sum("c").alias("anchors"))


PLACE_SQL = "SELECT event_id, event_id % 1000 / 1000.0::DOUBLE + 55 AS lat, event_id % 777 / 777.0::DOUBLE + 37 AS lng, value FROM events"


def _places(spark, sf_dir):
    lat = (F.col("event_id") % 1000) / F.lit(1000.0) + 55
    return table(spark, sf_dir, "events").select("event_id", lat.alias("lat"), ((F.col("event_id") % 777) / F.lit(777.0) + 37).alias("lng"), "value")


def _distance():
    """Kilometres from (55.5, 37.5) by the haversine formula."""
    a = F.pow(F.sin(F.radians(F.col("lat") - 55.5) / 2), 2) + F.cos(F.radians(F.lit(55.5))) * F.cos(F.radians("lat")) * F.pow(F.sin(F.radians(F.col("lng") - 37.5) / 2), 2)
    return F.lit(2 * 6371.0) * F.asin(F.sqrt(a))


KM_SQL = "2 * 6371.0 * asin(sqrt(pow(sin(radians(lat - 55.5) / 2), 2) + cos(radians(55.5)) * cos(radians(lat)) * pow(sin(radians(lng - 37.5) / 2), 2)))"


def _box(km: float, lat=None):
    """Degrees north and east that `km` span at a latitude; the cosine is at least 0.2, so that the box stays finite near the poles."""
    lat = F.lit(55.5) if lat is None else lat
    return km / 111.32, F.lit(km) / (F.lit(111.32) * F.greatest(F.lit(0.2), F.cos(F.radians(lat))))


def _around(km: float, lat: float) -> tuple[float, float]:
    """Degrees north and east that a circle of `km` reaches from a latitude, a billionth more; all the way round where it holds a pole."""
    r = km / 6371.0
    share = math.sin(r) / math.cos(math.radians(lat)) if r < math.pi / 2 - abs(math.radians(lat)) else 1.0
    return math.degrees(r) * (1 + 1e-9), math.degrees(math.asin(share)) * (1 + 1e-9) if share < 1 else 360.0


@query("J27", f"SELECT event_id, round({KM_SQL}, 3) AS km FROM ({PLACE_SQL}) WHERE {KM_SQL} <= 20")
def inside_circle(spark, sf_dir):
    """Places within 20 km; a box that holds the whole circle is asked first."""
    north, east = _around(20.0, 55.5)
    boxed = _places(spark, sf_dir).filter(F.col("lat").between(55.5 - north, 55.5 + north) & F.col("lng").between(37.5 - east, 37.5 + east))
    return boxed.withColumn("km", _distance()).filter("km <= 20").select("event_id", F.round("km", 3).alias("km"))


@query("M7", f"""
SELECT event_id, round(lat - 20 / 111.32, 6) AS south, round(lat + 20 / 111.32, 6) AS north, round(lng - 20 / (111.32 * greatest(0.2, cos(radians(lat)))), 6) AS west, round(lng + 20 / (111.32 * greatest(0.2, cos(radians(lat)))), 6) AS east FROM ({PLACE_SQL})""")
def bounding_box(spark, sf_dir):
    """The box of 20 km around every place."""
    north, east = _box(20.0, F.col("lat"))
    lat, lng = F.col("lat"), F.col("lng")
    return _places(spark, sf_dir).select("event_id", F.round(lat - north, 6).alias("south"), F.round(lat + north, 6).alias("north"), F.round(lng - east, 6).alias("west"), F.round(lng + east, 6).alias("east"))


@query("L15", f"SELECT event_id, round({KM_SQL}, 3) AS km FROM ({PLACE_SQL}) WHERE {KM_SQL} <= 20 ORDER BY {KM_SQL}, event_id LIMIT 25")
def nearest_first(spark, sf_dir):
    inside = _places(spark, sf_dir).withColumn("d", _distance()).filter("d <= 20")
    return inside.orderBy("d", "event_id").limit(25).select("event_id", F.round("d", 3).alias("km"))


@query("P19", f"SELECT event_id, lat BETWEEN -90 AND 90 AND lng BETWEEN -180 AND 180 AND NOT (abs(lat) < 0.01 AND abs(lng) < 0.01) AS ok FROM ({PLACE_SQL})")
def valid_places(spark, sf_dir):
    island = (F.abs("lat") < 0.01) & (F.abs("lng") < 0.01)
    return _places(spark, sf_dir).select("event_id", (F.col("lat").between(-90, 90) & F.col("lng").between(-180, 180) & ~island).alias("ok"))


def order_filters():
    """A catalogue over orders in the shape of the record list's filters."""
    return {
        "q": flt.contains("o_orderpriority"),
        "min_total": flt.number(lambda x: F.coalesce("o_totalprice", F.lit(0.0)) >= x),
        "days": flt.number(lambda x: F.col("o_orderdate") >= now() - F.make_interval(days=F.lit(int(x)))),
        "state": flt.choice({"open": F.col("o_orderstatus") == "O", "done": F.col("o_orderstatus") == "F"}),
    }


def order_sorts():
    return {"dear": [F.desc_nulls_last("o_totalprice"), F.asc("o_orderkey")], "new": [F.desc("o_orderdate"), F.asc("o_orderkey")]}


PRESETS = {"fresh": ({"state": "open", "days": "9000"}, "dear"), "urgent": ({"q": "urgent"}, "dear")}  # filters, sort


@query("P2", "SELECT o_orderkey, 'q,min_total' AS chips FROM orders WHERE contains(lower(o_orderpriority), 'urgent') AND o_totalprice >= 100000")
def combined_filters(spark, sf_dir):
    where, chips = flt.build(order_filters(), {"q": "URGENT", "min_total": "100000", "state": "none", "other": "1", "days": "x"})
    return table(spark, sf_dir, "orders").filter(where).select("o_orderkey", F.lit(",".join(chips)).alias("chips"))


@query("P4", "SELECT o_orderkey, o_totalprice FROM orders WHERE contains(lower(o_orderpriority), 'urgent') ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50")
def preset(spark, sf_dir):
    params, sort = PRESETS["urgent"]
    return table(spark, sf_dir, "orders").filter(flt.build(order_filters(), params)[0]).orderBy(*flt.order(order_sorts(), sort, "new")).limit(50).select("o_orderkey", "o_totalprice")


@query("P8", "SELECT n_nationkey, n_name FROM nation WHERE n_name IS NOT NULL AND contains(lower(n_name), 'on_1')")
def map_filters(spark, sf_dir):
    where, _ = flt.build({"metro": flt.contains("n_name"), "has_metro": flt.choice({"1": F.col("n_name").isNotNull()})}, {"metro": "ON_1", "has_metro": "1"})
    return table(spark, sf_dir, "nation").filter(where).select("n_nationkey", "n_name")


@query("P9", "SELECT event_id FROM events WHERE coalesce(nullif(value, 0), -1) >= 50")
def null_default(spark, sf_dir):
    return table(spark, sf_dir, "events").filter(F.coalesce(F.nullif("value", F.lit(0.0)), F.lit(-1.0)) >= 50).select("event_id")


@query("P11", f"SELECT event_id FROM events WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 14 DAY")
def since(spark, sf_dir):
    return table(spark, sf_dir, "events").filter(F.col("ts") >= now() - F.expr("INTERVAL 14 DAYS")).select("event_id")


@query("P15", "SELECT o_orderkey, o_totalprice >= 200000 AS passes FROM orders WHERE o_totalprice >= 200000 - 20000")
def worth_details(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter("o_totalprice >= 180000").select("o_orderkey", (F.col("o_totalprice") >= 200000).alias("passes"))


@query("P17", "SELECT d.doc_id FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id WHERE e.vec_id IS NULL OR e.embedding[1] >= 0")
def vector_gate(spark, sf_dir):
    near = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.element_at("embedding", 1).alias("near"))
    return table(spark, sf_dir, "documents").select("doc_id").join(near, "doc_id", "left").filter("near IS NULL OR near >= 0").select("doc_id")


@query("P23", "SELECT event_type, CASE WHEN count(*) = 0 THEN 'empty' WHEN avg(value) < 10 THEN 'low' WHEN count(DISTINCT user_id) < 5 THEN 'few' ELSE 'ok' END AS health FROM events GROUP BY 1")
def health(spark, sf_dir):
    runs = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.count_distinct("user_id").alias("users"))
    return runs.select("event_type", F.when(F.col("n") == 0, "empty").when(F.col("mean") < 10, "low").when(F.col("users") < 5, "few").otherwise("ok").alias("health"))


@query("A35", """
SELECT l_orderkey AS key, CASE WHEN bool_or(l_returnflag = 'R' AND l_quantity > 49) THEN 'veto' WHEN count(DISTINCT l_suppkey) < 2 THEN 'unknown'
  WHEN bool_or(l_returnflag = 'R') THEN 'red' WHEN bool_or(l_returnflag = 'A') THEN 'yellow' ELSE 'green' END AS level FROM lineitem GROUP BY 1""")
def worst_level(spark, sf_dir):
    flag = lambda x: F.bool_or(F.col("l_returnflag") == x)
    found = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.bool_or((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 49)).alias("veto"), F.count_distinct("l_suppkey").alias("n"), flag("R").alias("red"), flag("A").alias("yellow"))
    return found.select("key", F.when(F.col("veto"), "veto").when(F.col("n") < 2, "unknown").when(F.col("red"), "red").when(F.col("yellow"), "yellow").otherwise("green").alias("level"))


@query("A43", "SELECT count(*) AS total, count(*) FILTER (quality IS NOT NULL AND toxic IS NOT NULL) AS covered, count(*) FILTER (quality = 1 - toxic) AS agreed FROM labels")
def agreement(spark, sf_dir):
    both = F.col("quality").isNotNull() & F.col("toxic").isNotNull()
    return table(spark, sf_dir, "labels").agg(F.count(F.lit(1)).alias("total"), F.count_if(both).alias("covered"), F.count_if(F.col("quality") == 1 - F.col("toxic")).alias("agreed"))


@query("A47", "SELECT o_orderstatus AS kind, count(*) AS n, min(o_totalprice) AS low, max(o_totalprice) AS high, count(DISTINCT o_totalprice) AS n_scores FROM orders GROUP BY 1")
def run_summary(spark, sf_dir):
    x = "o_totalprice"
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.min(x).alias("low"), F.max(x).alias("high"), F.count_distinct(x).alias("n_scores"))


@query("A48", "SELECT source, count(*) AS n FROM documents GROUP BY 1")
def queue_note(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("L2", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY nullif(o_totalprice, 0) DESC NULLS LAST, o_orderkey LIMIT 30")
def sorted_records(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(*flt.order(order_sorts(), "dear", "new")).limit(30).select("o_orderkey", "o_totalprice")


@query("L4", "SELECT c_custkey, c_name FROM customer ORDER BY lower(c_name), c_custkey LIMIT 20")
def sorted_targets(spark, sf_dir):
    return table(spark, sf_dir, "customer").orderBy(F.lower("c_name"), "c_custkey").limit(20).select("c_custkey", "c_name")


@query("L5", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice >= 50000 ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 15")
def pending_cards(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter("o_orderstatus = 'O' AND o_totalprice >= 50000").orderBy(F.desc("o_totalprice"), "o_orderdate", "o_orderkey").limit(15).select("o_orderkey", "o_totalprice")


@query("L6", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_after_filter(spark, sf_dir):
    back = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(back, "o_orderkey", "left_anti").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey")


@query("L7", "SELECT o_orderkey FROM orders ORDER BY CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, o_orderdate DESC, o_orderkey LIMIT 40")
def ranked_by_case(spark, sf_dir):
    s = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").orderBy(F.when(s == "O", 0).when(s == "P", 1).otherwise(2), F.desc("o_orderdate"), "o_orderkey").limit(40).select("o_orderkey")


@query("L9", "SELECT event_id FROM events WHERE user_id % 10 = 3 AND event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 10")
def latest_hits(spark, sf_dir):
    return table(spark, sf_dir, "events").filter("user_id % 10 = 3 AND event_type = 'click'").orderBy(F.desc("ts"), F.desc("event_id")).limit(10).select("event_id")


@query("U1", "SELECT DISTINCT name FROM (SELECT c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier) WHERE name <> ''")
def distinct_names(spark, sf_dir):
    names = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name")).unionByName(table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name")))
    return names.filter("name <> ''").distinct()


@query("U6", "SELECT l_partkey AS id FROM lineitem WHERE l_quantity > 49 UNION SELECT p_partkey FROM part WHERE p_size > 45")
def candidate_union(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").filter("l_quantity > 49").select(F.col("l_partkey").alias("id"))
    return a.unionByName(table(spark, sf_dir, "part").filter("p_size > 45").select(F.col("p_partkey").alias("id"))).distinct()


@query("U7", "SELECT conv_id, turn, len(list_distinct(list_filter(regexp_extract_all(text, '[0-9]+'), lambda x: NOT list_contains([conv_id::VARCHAR, turn::VARCHAR], x)))) AS invented FROM conversations")
def invented_numbers(spark, sf_dir):
    said = F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))
    known = F.array(F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(F.array_except(said, known)).cast("long").alias("invented"))


@query("D5", "SELECT ts::DATE::VARCHAR AS day, count(*) AS n FROM events GROUP BY 1")
def day_prefix(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("M16", """SELECT event_id, contains(props, '"k": 1') AS found FROM events""")
def json_probe(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.contains("props", F.lit('"k": 1')).alias("found"))


@query("M17", "SELECT event_id, json_extract(regexp_extract('said: ' || props || ' end', '(?s)\\{.*\\}'), '$.k')::BIGINT AS k FROM events")
def first_json_block(spark, sf_dir):
    block = F.regexp_extract(F.concat(F.lit("said: "), "props", F.lit(" end")), r"(?s)\{.*\}", 0)
    return table(spark, sf_dir, "events").select("event_id", F.from_json(block, "k long")["k"].alias("k"))


@query("Z2", "SELECT o_orderkey AS key, unnest(range(1, least(floor(o_totalprice / 50000)::BIGINT, 5) + 1)) AS hit FROM orders WHERE o_totalprice >= 50000")
def repeated_evidence(spark, sf_dir):
    hits = F.least(F.floor(F.col("o_totalprice") / 50000), F.lit(5).cast("long"))
    return table(spark, sf_dir, "orders").filter("o_totalprice >= 50000").select(F.col("o_orderkey").alias("key"), F.explode(F.sequence(F.lit(1).cast("long"), hits)).alias("hit"))


@query("Z5", """
SELECT user_id, CASE WHEN s >= 3 THEN 'fake' WHEN s = 2 THEN 'suspect' ELSE 'none' END AS mark FROM (
  SELECT user_id, (count(*) >= 10)::INT + (count(DISTINCT event_type) <= 2)::INT + (max(value) > 100)::INT + (min(value) < 1)::INT + (count(DISTINCT ts::DATE) <= 3)::INT AS s FROM events GROUP BY 1)""")
def fake_mark(spark, sf_dir):
    one = lambda c: c.cast("int")
    signs = [F.count(F.lit(1)) >= 10, F.count_distinct("event_type") <= 2, F.max("value") > 100, F.min("value") < 1, F.count_distinct(F.to_date("ts")) <= 3]
    total = table(spark, sf_dir, "events").groupBy("user_id").agg(sum((one(c) for c in signs), F.lit(0)).alias("s"))
    return total.select("user_id", F.when(F.col("s") >= 3, "fake").when(F.col("s") == 2, "suspect").otherwise("none").alias("mark"))


@query("Z11", "SELECT o_orderkey AS key, 'own' AS origin FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT DISTINCT l_orderkey, 'external' FROM lineitem WHERE l_quantity > 48 AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def append_claims(spark, sf_dir):
    own = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("key"), F.lit("own").alias("origin"))
    other = table(spark, sf_dir, "lineitem").filter("l_quantity > 48").select(F.col("l_orderkey").alias("key")).join(own, "key", "left_anti").distinct()
    return own.unionByName(other.withColumn("origin", F.lit("external")))


@query("Z12", "SELECT l_orderkey AS key, l_linenumber AS line FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) <= 2")
def top_spans(spark, sf_dir):
    return hist.quota(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("line"), "l_extendedprice"), ["key"], [F.desc("l_extendedprice"), F.asc("line")], 2).select("key", "line")


@query("Z13", "SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS done FROM documents")
def done_or_left(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels")
    done = docs.join(labels, "doc_id", "left_semi").withColumn("done", F.lit(True))
    return done.unionByName(docs.join(labels, "doc_id", "left_anti").withColumn("done", F.lit(False)))


@query("Z22", "SELECT DISTINCT lower(trim(c_mktsegment)) || '|' || array_to_string(list_sort([c_nationkey % 3, c_nationkey % 2]), ',') AS request FROM customer")
def request_key(spark, sf_dir):
    areas = F.array_sort(F.array(F.col("c_nationkey") % 3, F.col("c_nationkey") % 2)).cast("array<string>")
    return table(spark, sf_dir, "customer").select(F.concat(F.lower(F.trim("c_mktsegment")), F.lit("|"), F.array_join(areas, ",")).alias("request")).distinct()


@query("Z23", f"SELECT c_custkey AS target, count(o_orderkey) AS total, count(*) FILTER (o_orderdate >= TIMESTAMP '{NOW}' - INTERVAL 9000 DAY) AS fresh FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def target_counters(spark, sf_dir):
    fresh = F.col("o_orderdate") >= now() - F.expr("INTERVAL 9000 DAYS")
    per = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("target")).agg(F.count(F.lit(1)).alias("total"), F.count_if(fresh).alias("fresh"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("target")).join(per, "target", "left").fillna(0, ["total", "fresh"])


@query("Z33", "SELECT l_orderkey AS key, string_agg(l_shipmode, ',' ORDER BY k, l_linenumber) AS fields FROM (SELECT l_orderkey, l_linenumber, l_returnflag AS l_shipmode, list_position(['R', 'A', 'N'], l_returnflag) AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY list_position(['R', 'A', 'N'], l_returnflag), l_linenumber) AS r FROM lineitem) WHERE r <= 6 GROUP BY 1")
def condition_lines(spark, sf_dir):
    place = F.array_position(F.array(*map(F.lit, "RAN")), F.col("l_returnflag"))
    rows = hist.quota(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", place.alias("k")), ["l_orderkey"], [F.asc("k"), F.asc("l_linenumber")], 6)
    fields = F.transform(F.array_sort(F.collect_list(F.struct("k", "l_linenumber", "l_returnflag"))), lambda s: s["l_returnflag"])
    return rows.groupBy(F.col("l_orderkey").alias("key")).agg(F.array_join(fields, ",").alias("fields"))


@query("Z35", "SELECT doc_id FROM documents ORDER BY coalesce(text, '') <> '' DESC, n_chars DESC, doc_id LIMIT 30")
def summary_order(spark, sf_dir):
    return table(spark, sf_dir, "documents").orderBy(F.desc(F.coalesce("text", F.lit("")) != ""), F.desc("n_chars"), "doc_id").limit(30).select("doc_id")


@query("Z39", "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 1 - quality ELSE quality END AS quality FROM labels")
def owner_flip(spark, sf_dir):
    old = table(spark, sf_dir, "labels").select("doc_id", "quality")
    new = old.filter("doc_id % 7 = 0").withColumn("quality", 1 - F.col("quality"))
    return old.join(new, "doc_id", "left_anti").unionByName(new)
