"""Queries of strings, dates, numbers, vectors and composite scores: ids T, D, M, Z and C of the operator inventory."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from attesta.functions import text as T
from attesta.functions import vectors as V
from attesta.operators import gate, review
from attesta.operators.selection import quantiles
from attesta.plans.registry import query
from attesta.sources.tables import NOW, now, table

_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query("T1", f"SELECT doc_id, array_to_string({_WORDS}, ' ') AS normal FROM documents")
def normal(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.normal(F.col("text")).alias("normal"))


@query("T2", f"SELECT doc_id, sha1(array_to_string({_WORDS}, ' ')) AS h FROM documents")
def hashed(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.text_hash(F.col("text")).alias("h"))


@query("T3", f"""
WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents)
SELECT doc_id, CASE WHEN len(w) = 0 THEN 0 WHEN len(w) < 4 THEN 1 ELSE len(list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))) END::INT AS shingles FROM w""")
def shingled(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.size(T.shingle_hashes(T.words(F.col("text")))).alias("shingles"))


@query("T5", "SELECT s_suppkey AS supplier, array_to_string(list_filter(string_split(trim(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w NOT IN ('llc', 'inc', 'supplier') AND w <> ''), ' ') AS name FROM supplier")
def company_names(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("supplier"), T.company_key(F.col("s_name"), [], ["llc", "inc", "supplier"]).alias("name"))


@query("T6", r"SELECT p_partkey AS part, array_to_string(list_sort(list_filter(regexp_extract_all(lower(p_name), '[\p{L}\p{N}_]+'), lambda w: w <> 'the')), ' ') AS key FROM part")
def title_keys(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), T.title_key(F.col("p_name"), ["the"]).alias("key"))


@query("T7", r"SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM pages")
def html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.strip_html(F.col("html")).alias("text"))


@query("T18", r"SELECT doc_id, (len(regexp_extract_all(lower(text), '\bidiot\b')) - len(regexp_extract_all(lower(text), '\b(?:not|no|never)\s+idiot\b')))::INT AS n FROM documents")
def negation_aware(spark, sf_dir):
    low = F.lower("text")
    return _docs(spark, sf_dir).select("doc_id", F.regexp_count(low, F.lit(r"(?<!\bnot\s)(?<!\bno\s)(?<!\bnever\s)\bidiot\b")).cast("int").alias("n"))


@query("T20", "SELECT doc_id, substr(text, greatest(p - 30, 1), p - greatest(p - 30, 1) + 67) AS quote FROM (SELECT doc_id, text, strpos(lower(text), 'license') AS p FROM documents) WHERE p > 0")
def quotes(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", review.quote(F.col("text"), "license").alias("quote")).filter("quote is not null")


@query("T24", r"SELECT doc_id, line_hash FROM (SELECT DISTINCT doc_id, substr(sha256(regexp_replace(lower(trim(t)), '\s+', ' ', 'g')), 1, 16) AS line_hash FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents) WHERE trim(t) <> '')")
def line_hashes(spark, sf_dir):
    lines = _docs(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n")).alias("t")).filter(F.trim("t") != "")
    return lines.select("doc_id", F.substring(F.sha2(F.regexp_replace(F.lower(F.trim("t")), r"\s+", " "), 256), 1, 16).alias("line_hash")).distinct()


@query("T28", "SELECT event_id, CASE WHEN value / 20 > 0 AND value / 20 <= 5 THEN round(value / 20, 4) END AS rating FROM events")
def ratings(spark, sf_dir):
    r = F.col("value") / 20
    return table(spark, sf_dir, "events").select("event_id", F.when((r > 0) & (r <= 5), F.round(r, 4)).alias("rating"))


@query("T35", r"SELECT doc_id, regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+', '<email>', 'g'), '\+?[0-9][0-9 ()-]{8,}[0-9]', '<phone>', 'g') AS text FROM documents")
def masked(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.mask_personal(F.col("text")).alias("text"))


@query("T40", """SELECT event_id, sha256('{"user":' || user_id || ',"type":"' || event_type || '"}') AS digest FROM events""")
def digests(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.sha2(F.to_json(F.struct(F.col("user_id").alias("user"), F.col("event_type").alias("type"))), 256).alias("digest"))


@query("T41", r"SELECT page_id, try_cast(nullif(regexp_extract(url, '([0-9]+)', 1), '') AS BIGINT) AS amount FROM pages")
def amounts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.nullif(F.regexp_extract("url", "([0-9]+)", 1), F.lit("")).try_cast("bigint").alias("amount"))


@query("D3", f"SELECT o_orderkey AS key FROM orders WHERE date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-02') BETWEEN 0 AND 180")
def date_window(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter(F.datediff(F.lit("1998-08-02").cast("date"), F.to_date("o_orderdate")).between(0, 180)).select(F.col("o_orderkey").alias("key"))


@query("D4", f"SELECT event_id, round((epoch(TIMESTAMP '{NOW}') - epoch(date_trunc('second', ts))) / 86400, 9) AS days FROM events")
def day_difference(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round((F.unix_timestamp(now()) - F.unix_timestamp("ts")) / 86400, 9).alias("days"))


@query("D6", f"SELECT event_id, round(exp(-(date_diff('day', CAST(ts AS DATE), DATE '{NOW[:10]}') / 30.0) / 18), 6) AS freshness FROM events")
def decay(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(F.exp(-(F.datediff(F.to_date(now()), F.to_date("ts")) / 30) / 18), 6).alias("freshness"))


@query("D7", "SELECT o_orderkey AS key, year(o_orderdate) * 12 + month(o_orderdate) - 1 AS month FROM orders")
def month_ordinal(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), (F.year("o_orderdate").cast("long") * 12 + F.month("o_orderdate") - 1).alias("month"))


@query("M1", "SELECT o_orderkey AS key, trunc(o_totalprice * 0.87)::BIGINT AS net FROM orders")
def net(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), (F.col("o_totalprice") * 0.87).cast("long").alias("net"))


@query("M2", "SELECT l_orderkey AS key, l_linenumber AS line, CASE WHEN l_discount > 0 AND l_tax > 0 THEN round(l_extendedprice * (1 - l_discount / 2 + l_tax / 2), 6) WHEN l_discount > 0 THEN round(l_extendedprice * (1 - l_discount), 6) WHEN l_tax > 0 THEN NULL ELSE l_extendedprice END AS point FROM lineitem")
def band_point(spark, sf_dir):
    p, d, t = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
    point = F.when((d > 0) & (t > 0), F.round(p * (1 - d / 2 + t / 2), 6)).when(d > 0, F.round(p * (1 - d), 6)).when(t > 0, F.lit(None)).otherwise(p)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("line"), point.alias("point"))


@query("M3", """
WITH m AS (SELECT p_brand, quantile_cont(p_retailprice, 0.25) AS q1, quantile_cont(p_retailprice, 0.75) AS q3, quantile_cont(p_retailprice, 0.5) AS med FROM part GROUP BY 1)
SELECT p_partkey AS part, CASE WHEN p_retailprice < q1 THEN 'below' WHEN p_retailprice > q3 THEN 'above' ELSE 'market' END AS marker, round(p_retailprice / med - 1, 4) AS deviation FROM part JOIN m USING (p_brand)""")
def markers(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    m = quantiles(p, ["p_brand"], "p_retailprice", [0.25, 0.75, 0.5]).select("p_brand", *(F.col("q")[i].alias(c) for i, c in enumerate(("q1", "q3", "med"))))
    mark = F.when(F.col("p_retailprice") < F.col("q1"), "below").when(F.col("p_retailprice") > F.col("q3"), "above").otherwise("market")
    return p.join(m, "p_brand").select(F.col("p_partkey").alias("part"), mark.alias("marker"), F.round(F.col("p_retailprice") / F.col("med") - 1, 4).alias("deviation"))


@query("M4", "SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings")
def norms(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"))


@query("M6", "SELECT c_custkey AS id, round(2 * 6371 * asin(least(1, sqrt(pow(sin(radians((c_custkey % 90) - 45) / 2), 2) + cos(radians(45)) * cos(radians(c_custkey % 90)) * pow(sin(radians((c_custkey % 180) - 90) / 2), 2)))), 4) AS km FROM customer")
def haversine(spark, sf_dir):
    lat, lng = F.col("c_custkey") % 90, F.col("c_custkey") % 180
    h = F.pow(F.sin(F.radians(lat - 45) / 2), 2) + F.cos(F.radians(F.lit(45))) * F.cos(F.radians(lat)) * F.pow(F.sin(F.radians(lng - 90) / 2), 2)
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.round(2 * 6371 * F.asin(F.least(F.lit(1.0), F.sqrt(h))), 4).alias("km"))


@query("M8", "SELECT event_id, round(1 / (1 + exp(-greatest(-30, least(30, (value - 50) / 10)))), 6) AS p FROM events")
def sigmoid(spark, sf_dir):
    z = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), (F.col("value") - 50) / 10))
    return table(spark, sf_dir, "events").select("event_id", F.round(1 / (1 + F.exp(-z)), 6).alias("p"))


@query("M9")
def gate_weights(spark, sf_dir):
    """Balanced full-batch logistic regression: forty gradient steps, each one aggregate over the rows."""
    e = table(spark, sf_dir, "embeddings").select("embedding", (F.col("label") >= 5).cast("double").alias("y"))
    weights = gate.train(e, "embedding", "y", rounds=40, rate=4.0, decay=1e-4)
    return spark.createDataFrame([(i, round(x, 6)) for i, x in enumerate(weights)], "place int, weight double")


@query("M10", "SELECT l_orderkey AS key, round(stddev_pop(l_quantity) / avg(l_quantity), 6) AS cv FROM lineitem GROUP BY 1")
def variation(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.round(F.stddev_pop("l_quantity") / F.avg("l_quantity"), 6).alias("cv"))


@query("M11", "SELECT source, ('0x' || substr(sha1(source), 1, 2))::INT % 5 = 0 AS held_out FROM (SELECT DISTINCT source FROM documents)")
def hash_split(spark, sf_dir):
    first = F.conv(F.substring(F.sha1(F.col("source").cast("binary")), 1, 2), 16, 10).cast("int")
    return _docs(spark, sf_dir).select("source").distinct().select("source", (first % 5 == 0).alias("held_out"))


@query("M12", "SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 1.0 WHEN quality = 1 THEN 0.85 WHEN toxic = 1 THEN 0.0 ELSE 0.15 END::DOUBLE AS soft FROM labels")
def soft_labels(spark, sf_dir):
    q, t = F.col("quality") == 1, F.col("toxic") == 1
    return table(spark, sf_dir, "labels").select("doc_id", F.when(q & ~t, 1.0).when(q, 0.85).when(t, 0.0).otherwise(0.15).alias("soft"))


@query("M14", "SELECT vec_id, len(embedding)::INT + 2 AS dim, round(embedding[1]::DOUBLE, 6) AS head, round(list_aggregate(embedding, 'max')::DOUBLE, 6) AS top FROM embeddings")
def augmented(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    v = F.concat("embedding", F.array(F.array_max("embedding"), F.array_min("embedding")))
    return e.select("vec_id", F.size(v).alias("dim"), F.round(v[0].cast("double"), 6).alias("head"), F.round(F.element_at(v, -2).cast("double"), 6).alias("top"))


@query("M15", "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json_field(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int").getField("k").alias("k"))


@query("Z3", "SELECT user_id, kind, n FROM (SELECT user_id, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'purchase') AS purchases, count(*) FILTER (event_type = 'view') AS views FROM events GROUP BY 1) UNPIVOT (n FOR kind IN (errors, purchases, views)) WHERE n > 0")
def unpivoted(spark, sf_dir):
    kinds = {"errors": "error", "purchases": "purchase", "views": "view"}
    wide = table(spark, sf_dir, "events").groupBy("user_id").agg(*(F.count_if(F.col("event_type") == v).alias(k) for k, v in kinds.items()))
    return wide.unpivot("user_id", list(kinds), "kind", "n").filter("n > 0")


@query("Z21", f"SELECT doc_id, list_sort(list_distinct(list_filter({_WORDS}, lambda w: length(w) >= 4)))[1:20] AS words FROM documents")
def query_words(spark, sf_dir):
    w = F.array_sort(F.array_distinct(F.filter(T.words(F.col("text")), lambda x: F.length(x) >= 4)))
    return _docs(spark, sf_dir).select("doc_id", F.slice(w, 1, 20).alias("words"))


@query("Z25", "SELECT l_partkey AS key, list_sort(list(DISTINCT l_suppkey)) AS sources FROM lineitem GROUP BY 1")
def sources_per_key(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("key")).agg(F.sort_array(F.collect_set("l_suppkey")).alias("sources"))


@query("Z27", "SELECT doc_id, t FROM (SELECT doc_id, t, row_number() OVER (PARTITION BY doc_id ORDER BY num DESC, pos) AS r FROM (SELECT doc_id, t, max(regexp_matches(t, '[0-9]')::INT) AS num, min(pos) AS pos FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents) WHERE length(t) > 12 GROUP BY 1, 2)) WHERE r <= 6")
def fact_lines(spark, sf_dir):
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "t")).filter(F.length("t") > 12)
    once = lines.groupBy("doc_id", "t").agg(F.max(F.col("t").rlike("[0-9]").cast("int")).alias("num"), F.min("pos").alias("pos"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("num"), "pos"))
    return once.withColumn("r", place).filter("r <= 6").select("doc_id", "t")


@query("Z36", "SELECT count(*) FILTER (abs(o_totalprice / 500000 - l / 500000) >= 0.05) AS drifted FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice) AS l FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey")
def drift(spark, sf_dir):
    new = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("l"))
    return table(spark, sf_dir, "orders").join(new, "o_orderkey").agg(F.count_if(F.abs(F.col("o_totalprice") / 500000 - F.col("l") / 500000) >= 0.05).alias("drifted"))


@query("C6", """
SELECT conv_id, turn, prompt, answer FROM (SELECT conv_id, turn, text AS answer, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prompt, role FROM conversations) WHERE role = 'assistant' AND prompt IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY md5(prompt) ORDER BY conv_id, turn) = 1""")
def dataset(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = table(spark, sf_dir, "conversations").withColumn("prompt", F.lag("text").over(w)).filter("role = 'assistant' and prompt is not null")
    rows = pairs.select("conv_id", "turn", "prompt", F.col("text").alias("answer"))
    first = rows.groupBy(F.md5(F.col("prompt").cast("binary")).alias("h")).agg(F.min_by(F.struct("conv_id", "turn", "prompt", "answer"), F.struct("conv_id", "turn")).alias("s"))
    return first.select("s.*")
