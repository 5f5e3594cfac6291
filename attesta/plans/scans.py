"""Queries of scans, parsers and sinks: ids S of the operator inventory."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from attesta.plans.registry import query
from attesta.sources import pages as src
from attesta.sources.tables import table
from attesta.streaming.events import shared


@query("S1", "SELECT * FROM part WHERE p_size >= 40")
def scan(spark, sf_dir):
    return table(spark, sf_dir, "part").filter("p_size >= 40")


@query("S2", "SELECT * FROM orders WHERE o_orderkey = 7")
def point(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter(F.col("o_orderkey") == 7)


@query("S3", "SELECT l_orderkey AS key, list_sort(list(DISTINCT l_suppkey)) AS sources FROM lineitem WHERE l_orderkey IN (1, 2, 3, 5, 7, 32) GROUP BY 1")
def in_list(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").filter(F.col("l_orderkey").isin(1, 2, 3, 5, 7, 32)).groupBy(F.col("l_orderkey").alias("key")).agg(F.sort_array(F.collect_set("l_suppkey")).alias("sources"))


@query("S4", "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def semi_join(spark, sf_dir):
    want = table(spark, sf_dir, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(want, "c_custkey", "left_semi").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


@query("S8", """SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href="([^"]+)"', 1))) AS link FROM pages""")
def page_links(spark, sf_dir):
    return src.links(table(spark, sf_dir, "pages"), "page_id", "html")


@query("S15", r"""
SELECT page_id, unnest(range(len(p)))::INT AS idx, unnest(p) AS html FROM (SELECT page_id, CASE WHEN len(a) > 0 THEN a WHEN len(l) > 0 THEN l ELSE q END AS p FROM (
  SELECT page_id, regexp_extract_all(html, '(?s)<article\b.*?</article>') AS a, regexp_extract_all(html, '(?s)<li\b[^>]*class="[^"]*review[^"]*".*?</li>') AS l, regexp_extract_all(html, '(?s)<p\b[^>]*>.*?</p>') AS q FROM pages))""")
def split_pages(spark, sf_dir):
    return src.review_blocks(table(spark, sf_dir, "pages"), "page_id", "html")


@query("S17", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def json_lines(spark, sf_dir):
    path = f"{shared(spark)}/events-{uuid.uuid4().hex}"
    table(spark, sf_dir, "events").select("event_id", "event_type").write.json(path)
    return src.read_lines(spark, path, "event_id long, event_type string").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
