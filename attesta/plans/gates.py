"""Queries of gates, judges, queues, vectors and stateful runs (ids C, F, L, N, P, X and Z of the operator inventory)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions import text as T
from attesta.functions import vectors as V
from attesta.operators import aggregates as agg
from attesta.operators import gate, history, similar, vector_index
from attesta.operators import generated as gen
from attesta.operators import injection as inj
from attesta.operators import reviews as R
from attesta.operators.selection import share_by_hash
from attesta.plans import derived as D
from attesta.plans.employers import _FAKE, _NORMAL, suspicious
from attesta.plans.registry import query
from attesta.plans.signals import _FEATURES, _findings_sql
from attesta.sources.tables import NOW, now, table
from attesta.streaming import events as st
from attesta.streaming import state
from attesta.streaming.events import written

# Gates over vectors --------------------------------------------------------------------------------------------------

_HASHED = f"(SELECT doc_id, company, sha1({_NORMAL}) AS h, text FROM {D.REVIEWS_SQL})"
_WEIGHT = "list_transform(range(len(v)), lambda i: ((i % 7) - 3) / 10.0)"
_GATE = rf"""
{_FEATURES}, hx AS (SELECT * FROM {_HASHED}),
kv AS (SELECT h, min(doc_id) AS first FROM hx GROUP BY h), vx AS (SELECT kv.h, embedding::DOUBLE[] AS e FROM kv JOIN embeddings ON vec_id = first % (SELECT count(*) FROM embeddings)),
ga AS (SELECT hx.doc_id, company, list_concat(e, [{', '.join(f'{c}::DOUBLE' for c in gen.FEATURES)}]) AS v FROM hx JOIN vx USING (h) JOIN h USING (doc_id)),
gp AS (SELECT doc_id, company, round(1 / (1 + exp(-greatest(-30, least(30, list_dot_product(v, {_WEIGHT}))))), 6) AS p FROM ga)"""


def _vectors(spark, sf_dir, hashed: DataFrame) -> DataFrame:
    """(h, e): the vector of each text's digest."""
    e = table(spark, sf_dir, "embeddings")
    n = e.agg(F.count(F.lit(1))).first()[0]
    first = hashed.groupBy("h").agg((F.min("doc_id") % n).alias("vec_id"))
    return first.join(e.select("vec_id", F.col("embedding").cast("array<double>").alias("e")), "vec_id").select("h", "e")


def gate_scores(spark, sf_dir) -> DataFrame:
    """(doc_id, company, p): the linear gate on a text's vector and its nine features; vectors are kept by digest, so equal texts share one."""
    rows = D.reviews(spark, sf_dir).select("doc_id", "company", T.text_hash(F.col("text")).alias("h"), *(c.alias(k) for k, c in gen.feature_parts(F.col("text")).items()))
    flags = F.array(*(c.cast("double") for c in gen.features().values()))
    known = rows.select("doc_id", "company", "h", flags.alias("f")).join(_vectors(spark, sf_dir, rows), "h")
    v = F.concat("e", "f")
    weights = F.transform(v, lambda _, i: ((i % 7) - 3) / F.lit(10.0))
    z = F.aggregate(F.zip_with(v, weights, lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x)
    return known.select("doc_id", "company", F.round(1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z)))), 6).alias("p"))


@query("Z7", f"WITH {_GATE} SELECT doc_id, p FROM gp")
def gate_by_hash(spark, sf_dir):
    return gate_scores(spark, sf_dir).select("doc_id", "p")


@query("Z8", f"WITH {_GATE} SELECT doc_id FROM gp WHERE p >= 0.55")
def solved(spark, sf_dir):
    """The yes of a single threshold, without asking anyone."""
    return gate_scores(spark, sf_dir).filter("p >= 0.55").select("doc_id")


_JUDGE = f"""ju AS (SELECT doc_id, company, p, CASE WHEN p >= 0.7 THEN 'yes' WHEN p <= 0.3 THEN 'no' ELSE 'ask' END AS side, row_number() OVER (PARTITION BY company, p > 0.3 AND p < 0.7 ORDER BY round(abs(p - 0.5), 6), doc_id) AS r FROM gp),
jd AS (SELECT doc_id, company, p, CASE WHEN side <> 'ask' THEN side WHEN r <= 12 AND doc_id % 3 = 0 THEN 'yes' WHEN r <= 12 THEN 'no' ELSE 'undecided' END AS decision FROM ju)"""


def merged_decisions(scores: DataFrame, answers: DataFrame, most: int = 12) -> DataFrame:
    """(doc_id, company, p, decision): sure sides by the gate; of each owner the `most` most doubtful by the judge's answers."""
    side = F.when(F.col("p") >= 0.7, "yes").when(F.col("p") <= 0.3, "no")
    marked = scores.withColumn("side", side)
    doubt = F.row_number().over(Window.partitionBy("company", F.col("side").isNull()).orderBy(F.round(F.abs(F.col("p") - 0.5), 6), "doc_id"))
    asked = marked.withColumn("asked", F.col("side").isNull() & (doubt <= most)).join(answers, "doc_id", "left")
    said = F.when(F.col("asked") & F.col("answer").isNotNull(), F.when(F.col("answer"), "yes").otherwise("no"))
    return asked.select("doc_id", "company", "p", F.coalesce("side", said, F.lit("undecided")).alias("decision"))


@query("Z9", f"WITH {_GATE}, {_JUDGE} SELECT doc_id, decision FROM jd")
def merged(spark, sf_dir):
    answers = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 3 == 0).alias("answer"))
    return merged_decisions(gate_scores(spark, sf_dir), answers).select("doc_id", "decision")


_ANSWERS = "CASE doc_id % 4 WHEN 0 THEN 'manager was fair' WHEN 1 THEN 'not in this text at all' WHEN 2 THEN '' ELSE 'buy now' END"


@query("Z10", rf"""
WITH {_findings_sql(D.ATTACKS_SQL, 'doc_id')}, red AS (SELECT DISTINCT doc_id FROM found WHERE level = 'red'), a AS (SELECT doc_id, {_ANSWERS} AS quote, {_NORMAL} AS n FROM {D.REVIEWS_SQL})
SELECT doc_id FROM a WHERE quote <> '' AND contains(n, quote) AND doc_id NOT IN (SELECT doc_id FROM red)""")
def accepted_answers(spark, sf_dir):
    """A judge's answers that quote their text word for word; texts with red findings aren't shown to it."""
    red = inj.findings(D.attacked(spark, sf_dir), "doc_id", "text").filter("level = 'red'").select("doc_id")
    rows = D.reviews(spark, sf_dir).select("doc_id", F.expr(_ANSWERS).alias("quote"), T.normal(F.col("text")).alias("n"))
    return rows.join(red, "doc_id", "left_anti").filter((F.col("quote") != "") & F.contains("n", F.col("quote"))).select("doc_id")


_MARKERS = {"format": ("remote", "office"), "process": ("interview", "release"), "other": ("salary", "pay")}
_FOUND = "[" + ", ".join(f"CASE WHEN {D.any_sql('low', v)} THEN '{k}' END" for k, v in _MARKERS.items()) + "]"
_STORED = "CASE doc_id % 4 WHEN 0 THEN ['format', 'other'] WHEN 1 THEN ['process'] ELSE []::VARCHAR[] END"


def _facts(spark, sf_dir) -> DataFrame:
    low = F.lower("text")
    found = F.array_compact(F.array(*(F.when(inj.contains_any(low, v), F.lit(k)) for k, v in _MARKERS.items())))
    stored = F.when(F.col("doc_id") % 4 == 0, F.array(F.lit("format"), F.lit("other"))).when(F.col("doc_id") % 4 == 1, F.array(F.lit("process"))).otherwise(F.array().cast("array<string>"))
    return D.reviews(spark, sf_dir).select("doc_id", found.alias("found"), stored.alias("stored"))


@query("Z14", f"""
WITH f AS (SELECT doc_id, list_filter({_FOUND}, lambda x: x IS NOT NULL) AS found, {_STORED} AS stored FROM (SELECT doc_id, lower(text) AS low FROM {D.REVIEWS_SQL})), d AS (SELECT * FROM f WHERE len(found) = 0)
SELECT field, count(*) AS lost, (SELECT count(*) FROM d) AS dropped, (SELECT count(*) FROM d WHERE len(stored) > 0) AS hurt FROM (SELECT unnest(stored) AS field FROM d) GROUP BY 1""")
def gate_cost(spark, sf_dir):
    """What a gate on markers would drop: rows, the facts lost by field, and the rows that lose any."""
    dropped = _facts(spark, sf_dir).filter(F.size("found") == 0)
    total = dropped.agg(F.count(F.lit(1)).alias("dropped"), F.count_if(F.size("stored") > 0).alias("hurt"))  # one row
    return dropped.select(F.explode("stored").alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("lost")).crossJoin(F.broadcast(total))


@query("P16", f"""
WITH f AS (SELECT doc_id, list_filter({_FOUND}, lambda x: x IS NOT NULL) AS found, {_STORED} AS stored FROM (SELECT doc_id, lower(text) AS low FROM {D.REVIEWS_SQL}))
SELECT doc_id, list_sort(list_filter(found, lambda x: NOT list_contains(stored, x))) AS wanted FROM f WHERE len(list_filter(found, lambda x: NOT list_contains(stored, x))) > 0""")
def wanted_fields(spark, sf_dir):
    rows = _facts(spark, sf_dir).select("doc_id", F.array_sort(F.array_except("found", "stored")).alias("wanted"))
    return rows.filter(F.size("wanted") > 0)


@query("Z15", f"""
WITH {_FEATURES}, s AS (SELECT round(({' + '.join(gen.FEATURES)}) / 9.0, 3) AS p, toxic AS y FROM h JOIN labels USING (doc_id) WHERE toxic IS NOT NULL)
SELECT round((SELECT sum((a.p > b.p)::INT + 0.5 * (a.p = b.p)::INT) FROM s a, s b WHERE a.y = 1 AND b.y = 0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS auroc, count(*) FILTER (y = 0 AND p >= 0.5) AS wrong, count(*) FILTER (y = 1 AND p < 0.5) AS missed FROM s""")
def rules_alone(spark, sf_dir):
    """How well the share of features alone tells the labels apart."""
    rows = D.reviews(spark, sf_dir).select("doc_id", *(c.alias(k) for k, c in gen.feature_parts(F.col("text")).items()))
    p = F.round(sum(gen.features().values(), F.lit(0)) / 9.0, 3)
    s = written(rows.select("doc_id", p.alias("p")).join(table(spark, sf_dir, "labels").filter("toxic is not null").select("doc_id", F.col("toxic").alias("y")), "doc_id").select("p", "y"))  # read four times
    area = agg.auroc(s, "p", "y")
    counts = s.agg(F.count_if((F.col("y") == 0) & (F.col("p") >= 0.5)).alias("wrong"), F.count_if((F.col("y") == 1) & (F.col("p") < 0.5)).alias("missed"))
    return area.select(F.round(F.col(area.columns[0]), 6).alias("auroc")).crossJoin(counts)


@query("Z16", f"""
WITH hx AS (SELECT * FROM {_HASHED}), kv AS (SELECT h, min(doc_id) AS first FROM hx GROUP BY h), m AS (SELECT first % (SELECT count(*) FROM embeddings) AS vec_id, min(first) AS k FROM kv GROUP BY 1), vx AS (SELECT k, embedding::DOUBLE[] AS e FROM m JOIN embeddings USING (vec_id))
SELECT a.k AS a, b.k AS b, round(list_cosine_similarity(a.e, b.e), 4) AS cosine FROM vx a JOIN vx b ON a.k < b.k WHERE list_cosine_similarity(a.e, b.e) >= 0.3""")
def paraphrases(spark, sf_dir):
    """Pairs of texts whose vectors are near; texts with one vector count as one, under the first of them."""
    hashed = D.reviews(spark, sf_dir).select("doc_id", T.text_hash(F.col("text")).alias("h"))
    e = table(spark, sf_dir, "embeddings")
    n = e.agg(F.count(F.lit(1))).first()[0]
    first = hashed.groupBy("h").agg(F.min("doc_id").alias("first")).groupBy((F.col("first") % n).alias("vec_id")).agg(F.min("first").alias("k"))
    return vector_index.near_pairs(first.join(e, "vec_id").select("k", "embedding"), "k", "embedding", 0.3)


@query("Z17", "SELECT event_id, array_to_string(list_filter([event_type, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'user ' || user_id END, props], lambda x: x IS NOT NULL AND trim(x) <> ''), chr(10)) AS text FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def vector_batch(spark, sf_dir):
    """The latest 500 records' texts for a vector model; blank fields are skipped."""
    e = table(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(500)
    fields = F.array("event_type", F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit("user "), F.col("user_id").cast("string"))), "props")
    return e.select("event_id", F.array_join(F.filter(fields, lambda x: F.trim(x) != ""), "\n").alias("text"))


@query("Z18", "WITH m AS (SELECT label, list(embedding::DOUBLE[] ORDER BY vec_id) AS l, string_agg('v' || vec_id, '. ' ORDER BY vec_id) AS t FROM embeddings GROUP BY 1), a AS (SELECT label, t, list_transform(range(1, len(l[1]) + 1), lambda i: list_avg(list_transform(l, lambda e: e[i]))) AS c FROM m) SELECT label, sha1(t) AS text_hash, round(sqrt(list_dot_product(c, c)), 6) AS size, round(c[1], 6) AS head FROM a")
def owner_vectors(spark, sf_dir):
    """Each owner's text, joined from its facts in order, and the mean of their vectors."""
    e = table(spark, sf_dir, "embeddings")
    text = e.groupBy("label").agg(F.array_join(F.transform(F.array_sort(F.collect_list("vec_id")), lambda v: F.concat(F.lit("v"), v.cast("string"))), ". ").alias("t"))
    mean = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    vector = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c"))
    return text.join(vector, "label").select("label", F.sha1(F.col("t").cast("binary")).alias("text_hash"), F.round(V.norm(F.col("c")), 6).alias("size"), F.round(F.col("c")[0], 6).alias("head"))


_POINTS = "list_sum(list_transform(list_filter(string_split(signals, ','), lambda s: s <> ''), lambda s: CASE s " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in R.SIGNALS.items()) + " END))"


@query("C4", f"""
WITH {_FAKE}, {_GATE}, {_JUDGE}, t AS (SELECT fv.doc_id, signals, decision = 'yes' AS ad, coalesce({_POINTS}, 0) AS points, own FROM fv JOIN jd USING (doc_id) JOIN (SELECT doc_id, own FROM fk) USING (doc_id)),
u AS (SELECT doc_id, ad, round(least(1.0, (points + CASE WHEN ad THEN 0.5 ELSE 0 END) / 6.0), 2) AS sc, own OR ad AS own FROM t)
SELECT doc_id, ad, CASE WHEN sc >= 0.6 AND NOT own THEN 0.6 ELSE sc END AS fake_score, CASE WHEN sc >= 0.6 AND own THEN 'fake' WHEN sc >= 0.35 THEN 'suspect' ELSE 'clean' END AS label FROM u""")
def gated_scoring(spark, sf_dir):
    """Bought reviews, with the gate's and judge's verdict on advertising as one more sign."""
    found = suspicious(D.reviews(spark, sf_dir)).select("doc_id", F.filter(F.split("signals", ","), lambda s: s != "").alias("signals"))
    answers = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 3 == 0).alias("answer"))
    ads = merged_decisions(gate_scores(spark, sf_dir), answers).select("doc_id", (F.col("decision") == "yes").alias("ad"))
    rows = found.join(ads, "doc_id").withColumn("signals", F.when(F.col("ad"), F.array_append("signals", F.lit("llm_ad"))).otherwise(F.col("signals")))
    score, label = R.fake_verdict(F.col("signals"))
    return rows.select("doc_id", "ad", score.alias("fake_score"), label.alias("label"))


@query("C5")
def trained_gate(spark, sf_dir):
    """A gate trained on four fifths of the owners and asked of the rest: its area under the curve, wrong and missed at one half. tests hold it to a limit."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), (F.col("label") >= 5).cast("double").alias("y"))
    held = F.conv(F.substring(F.sha1(F.concat(F.lit("owner "), (F.col("vec_id") % 97).cast("string")).cast("binary")), 1, 2), 16, 10).cast("int") % 5 == 0
    rows = e.withColumn("held", held)
    weights = gate.train(rows.filter("not held"), "v", "y", rounds=40, rate=4.0, decay=1e-4)
    z = F.aggregate(F.zip_with("v", F.array(*(F.lit(float(w)) for w in weights[:-1])), lambda x, w: x * w), F.lit(float(weights[-1])), lambda s, x: s + x)
    asked = rows.filter("held").select(F.round(1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z)))), 6).alias("p"), F.col("y").cast("int").alias("y"))
    area = agg.auroc(asked, "p", "y")
    counts = asked.agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("y") == 0) & (F.col("p") >= 0.5)).alias("wrong"), F.count_if((F.col("y") == 1) & (F.col("p") < 0.5)).alias("missed"))
    return area.select(F.round(F.col(area.columns[0]), 4).alias("auroc")).crossJoin(counts)


# Queues and limits ---------------------------------------------------------------------------------------------------


@query("L11", "SELECT b.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a, embeddings b WHERE a.vec_id = 0 AND b.vec_id <> 0 ORDER BY cosine DESC, id LIMIT 10")
def top_vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    asked = e.filter("vec_id = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv"))
    return similar.most_similar(e, "vec_id", "embedding", asked, 10).select("id", "cosine")


@query("L12", """
WITH p AS (SELECT l_suppkey AS owner, l_linenumber AS page, bool_and(l_returnflag = 'A') AS known FROM lineitem GROUP BY ALL), s AS (SELECT owner, min(page) FILTER (known) AS stop FROM p GROUP BY 1)
SELECT owner, key, line FROM (SELECT l_suppkey AS owner, l_orderkey AS key, l_linenumber AS line, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_linenumber, l_orderkey, l_partkey) AS r FROM lineitem JOIN s ON owner = l_suppkey WHERE stop IS NULL OR l_linenumber < stop) WHERE r <= 40""")
def scanned(spark, sf_dir):
    """Pages of each owner, read in order up to the first that is known as a whole, and at most 40 records of each."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("owner"), F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("line"), "l_partkey", "l_returnflag")
    pages = li.groupBy("owner", "line").agg(F.min(F.col("l_returnflag") == "A").alias("known"))
    stop = pages.groupBy("owner").agg(F.min(F.when(F.col("known"), F.col("line"))).alias("stop"))
    fresh = li.join(stop, "owner").filter("stop is null or line < stop")
    return history.quota(fresh, ["owner"], ["line", "key", "l_partkey"], 40).select("owner", "key", "line")


@query("L13", "SELECT o_orderkey AS key, o_totalprice AS score FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 7) ORDER BY score DESC, key LIMIT 100")
def geocode_queue(spark, sf_dir):
    """The hundred best records that have an address and no place yet."""
    placed = table(spark, sf_dir, "lineitem").filter("l_linenumber = 7").select(F.col("l_orderkey").alias("key"))
    rows = table(spark, sf_dir, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("score"))
    return rows.join(placed, "key", "left_anti").orderBy(F.desc("score"), "key").limit(100)


@query("N16")
def cascades(spark, sf_dir):
    """Of each stage up to three models: again and again the fastest of those within 0.05 of the best score left. tests hold it against brute force."""
    e = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("stage"), (F.col("user_id") % 12).alias("model")).agg(F.round(F.avg("value") / 100, 3).alias("score"), F.round(F.stddev_pop("value"), 2).alias("seconds"))
    return cascade(e)


def cascade(rows: DataFrame, tolerance: float = 0.05, most: int = 3) -> DataFrame:
    """(stage, place, model, score, seconds) from one row per (stage, model): a stage has as many rows as there are models."""

    def pick(pdf):
        left, out = sorted(zip(pdf["model"], pdf["score"], pdf["seconds"])), []
        while left and len(out) < most:
            top = max(x[1] for x in left)
            best = min((x for x in left if x[1] >= top - tolerance), key=lambda x: (x[2], x[0]))
            out.append((pdf["stage"].iloc[0], len(out) + 1, *best))
            left.remove(best)
        return type(pdf)(out, columns=["stage", "place", "model", "score", "seconds"])

    return rows.groupBy("stage").applyInPandas(pick, "stage string, place int, model long, score double, seconds double")


@query("Z38", """
WITH e AS (SELECT event_type AS stage, user_id % 12 AS model, round(avg(value) / 100, 3) AS score, round(stddev_pop(value), 2) AS seconds FROM events GROUP BY ALL)
SELECT stage, model, score FROM (SELECT *, max(score) OVER (PARTITION BY stage) AS top FROM e) WHERE score >= top - 0.05 QUALIFY row_number() OVER (PARTITION BY stage ORDER BY seconds, model) = 1""")
def recommended(spark, sf_dir):
    return cascades(spark, sf_dir).filter("place = 1").select("stage", "model", "score")


@query("N12", r"""
WITH w AS (SELECT doc_id, lang AS company, doc_id % 9 AS d, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, company, d, CASE WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w WHERE len(w) > 0),
g AS (SELECT doc_id, company, d, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id, b.doc_id AS other FROM g a JOIN g b ON a.company = b.company AND a.g = b.g AND b.d BETWEEN a.d AND a.d + 6 GROUP BY ALL HAVING round(count(*) / least(any_value(a.n), any_value(b.n))::DOUBLE, 4) >= 0.6)
SELECT doc_id, count(*) AS n FROM p GROUP BY 1 HAVING count(*) >= 3""")
def anchors(spark, sf_dir):
    """Reviews that, with those of their company that are alike and come within a week from them, make a group of three or more."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "text", F.date_add(F.lit("2023-06-01").cast("date"), (F.col("doc_id") % 9).cast("int")).alias("dated_at"))
    return similar.anchored_groups(rows, "doc_id", "lang", "text", "dated_at").filter("n >= 3")


@query("M13", "SELECT doc_id, sha1('7:' || doc_id) < (SELECT quantile_disc(sha1('7:' || doc_id), 0.2) FROM documents) AS val FROM documents")
def seeded_split(spark, sf_dir):
    """A split of a stated share by the order of seeded hashes: as if shuffled with a seed."""
    h = table(spark, sf_dir, "documents").select("doc_id", F.sha1(F.concat(F.lit("7:"), F.col("doc_id").cast("string")).cast("binary")).alias("h"))
    return h.crossJoin(F.broadcast(share_by_hash(h, "h", 0.2))).select("doc_id", (F.col("h") < F.col("edge")).alias("val"))  # one row


# State ---------------------------------------------------------------------------------------------------------------


@query("P22", f"SELECT event_type AS kind, max(ts) AS last, epoch(TIMESTAMP '{NOW}' - max(ts)) >= 3 * 3600 AS due FROM events WHERE value > 90 GROUP BY 1")
def cooled_down(spark, sf_dir):
    """Kinds of alerts, when each was last sent, and whether three hours have passed since."""
    last = table(spark, sf_dir, "events").filter("value > 90").groupBy(F.col("event_type").alias("kind")).agg(F.max("ts").alias("last"))
    return last.select("kind", "last", (F.unix_micros(now()) - F.unix_micros(F.col("last").cast("timestamp")) >= 3 * 3_600_000_000).alias("due"))


_COMPLETE = [True, True, False, True, True]  # of the five runs, the third breaks off


@query("X2", """
WITH s AS (SELECT DISTINCT user_id, event_id % 5 AS run FROM events WHERE user_id % 7 <> event_id % 5 AND (event_id % 5 <> 2 OR user_id % 2 = 0)), k AS (SELECT user_id, min(run) AS first FROM s GROUP BY 1), g AS (SELECT user_id, run FROM k, range(5) r(run) WHERE run >= first),
f AS (SELECT g.user_id, g.run, s.user_id IS NOT NULL AS seen FROM g LEFT JOIN s USING (user_id, run) WHERE s.user_id IS NOT NULL OR g.run <> 2), w AS (SELECT *, lag(seen) OVER (PARTITION BY user_id ORDER BY run) AS before FROM f)
SELECT user_id, arg_max(seen, run) AS active, 1 + sum((seen AND before = false)::INT)::BIGINT AS cycles FROM w GROUP BY 1""")
def seen_and_missing(spark, sf_dir):
    """Five runs, a file each: keys that a complete run lacks become inactive, and count one more cycle when they are back."""
    path = st.shared(spark)
    run = F.col("event_id") % 5
    e = table(spark, sf_dir, "events").filter("user_id % 7 <> event_id % 5").filter((run != 2) | (F.col("user_id") % 2 == 0))
    for r, clock in enumerate(state.run_clock(_COMPLETE)):
        e.filter(run == r).select("user_id", F.lit(clock).alias("clock")).distinct().coalesce(1).write.mode("append").parquet(f"{path}/runs")
    runs = spark.readStream.schema("user_id long, clock int").option("maxFilesPerTrigger", 1).parquet(f"{path}/runs")
    changes = state.presence_changes(runs, "user_id", "long")
    state.run_available(changes, path)
    told = state.presence(spark.read.schema(changes.schema).parquet(f"{path}/out"))
    return told.select(F.col("key").alias("user_id"), "active", "cycles")


@query("X8", "SELECT event_id, round(value * 2, 4) AS result FROM events")
def background(spark, sf_dir):
    """Records handed on to a background stage in portions of twenty, batch by batch."""
    rows = st.source(spark, f"{sf_dir}/events.parquet").select("event_id", "value")
    done = st.run_portions(rows, 20, lambda portions: portions.withColumn("result", F.round(F.col("value") * 2, 4)))
    return done.select("event_id", "result")


# Functions and registries --------------------------------------------------------------------------------------------


@query("F1", "SELECT doc_id, contains(lower(text), 'über') AS found FROM documents")
def lower_case(spark, sf_dir):
    """Lower case that knows letters beyond ASCII, as a SQL expression."""
    return table(spark, sf_dir, "documents").selectExpr("doc_id", "contains(lower(text), 'über') AS found")


STEPS = {"trimmed": lambda df: df.withColumn("name", F.trim("name")), "lower": lambda df: df.withColumn("name", F.lower("name")), "short": lambda df: df.withColumn("name", F.substring("name", 1, 8))}


@query("F2", "SELECT s_suppkey AS id, substr(lower(trim(s_name)), 1, 8) AS name FROM supplier")
def registered_steps(spark, sf_dir):
    """Steps looked up by name in a registry and applied in the order asked for; unknown names are left out."""
    df = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    for name in ("trimmed", "lower", "no such step", "short"):
        df = STEPS.get(name, lambda x: x)(df)
    return df


@query("F4", "SELECT page_id, replace(replace(replace(replace('&eacute;&lt;' || page_id || '&gt;&#x41;', '&eacute;', 'é'), '&lt;', '<'), '&gt;', '>'), '&#x41;', 'A') AS text FROM pages")
def entities(spark, sf_dir):
    """Every named and numbered entity of HTML: the one text function that no column expression has."""
    from attesta.sources.pages import unescape

    return table(spark, sf_dir, "pages").select("page_id", unescape(F.concat(F.lit("&eacute;&lt;"), F.col("page_id").cast("string"), F.lit("&gt;&#x41;"))).alias("text"))


# Records -------------------------------------------------------------------------------------------------------------


@query("Z6", r"""
WITH s AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)), '^www\.', '') AS host, regexp_replace(lower(url), '[?#].*$', '') AS u FROM pages)
SELECT page_id, host, CASE WHEN page_id % 4 = 0 THEN 'positive' WHEN page_id % 4 = 1 THEN 'negative' ELSE 'unknown' END AS polarity FROM s WHERE host LIKE '%.org' OR host LIKE '%.com' QUALIFY row_number() OVER (PARTITION BY u ORDER BY page_id) = 1""")
def search_reviews(spark, sf_dir):
    """Search hits of allowed hosts, each address once, with their polarity."""
    p = table(spark, sf_dir, "pages").select("page_id", T.host(F.col("url")).alias("host"), F.regexp_replace(F.lower("url"), "[?#].*$", "").alias("u"))
    ok = p.filter(F.col("host").endswith(".org") | F.col("host").endswith(".com"))
    once = ok.groupBy("u").agg(F.min_by(F.struct("page_id", "host"), "page_id").alias("s")).select("s.*")
    snippet = F.when(F.col("page_id") % 4 == 0, "good pay").when(F.col("page_id") % 4 == 1, "the boss was rude").otherwise("")
    polarity = F.when(F.contains(snippet, F.lit("good pay")), "positive").when(F.contains(snippet, F.lit("rude")), "negative").otherwise("unknown")
    return once.select("page_id", "host", polarity.alias("polarity"))


@query("Z19", "SELECT p_partkey AS part, CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_size % 2 = (p_partkey % 2) THEN p_type ELSE NULL END AS reused FROM part")
def reused_descriptions(spark, sf_dir):
    """A stored description is used again unless the record's date has changed; a null date equals a null date."""
    p = table(spark, sf_dir, "part")
    stored = p.filter("p_partkey % 3 <> 0").select("p_partkey", F.col("p_type").alias("body"), (F.col("p_size") % 2).alias("was"))
    rows = p.select("p_partkey", (F.col("p_partkey") % 2).cast("int").alias("is"))
    joined = rows.join(stored, (rows["p_partkey"] == stored["p_partkey"]) & rows["is"].eqNullSafe(stored["was"]), "left")
    return joined.select(rows["p_partkey"].alias("part"), F.col("body").alias("reused"))


@query("Z26", """
WITH b AS (SELECT o_custkey AS owner, CASE o_orderstatus WHEN 'F' THEN 'skills' WHEN 'O' THEN 'jobs' ELSE 'about' END AS section, o_totalprice > 100000 AS ok FROM orders)
SELECT *, row_number() OVER (PARTITION BY owner ORDER BY CASE section WHEN 'about' THEN 0 WHEN 'jobs' THEN 1 ELSE 2 END)::INT AS place FROM (SELECT owner, section, count(*) AS n, sum(ok::INT)::BIGINT AS confirmed FROM b GROUP BY ALL)""")
def ordered_sections(spark, sf_dir):
    order = F.array(*map(F.lit, ("about", "jobs", "skills")))
    section = F.when(F.col("o_orderstatus") == "F", "skills").when(F.col("o_orderstatus") == "O", "jobs").otherwise("about")
    b = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("owner"), section.alias("section")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_totalprice") > 100000).alias("confirmed"))
    return b.select("owner", "section", F.row_number().over(Window.partitionBy("owner").orderBy(F.array_position(order, F.col("section")))).alias("place"), "n", "confirmed")


@query("Z28", """
WITH m AS (SELECT o_custkey AS owner, count(DISTINCT date_trunc('month', o_orderdate)) AS months FROM orders GROUP BY 1)
SELECT c_custkey AS owner, coalesce(months, 0) AS months, CASE c_custkey % 3 WHEN 0 THEN 'senior' WHEN 1 THEN 'middle' ELSE 'junior' END AS claimed, coalesce(months, 0) < CASE c_custkey % 3 WHEN 0 THEN 12 WHEN 1 THEN 5 ELSE 0 END AS contradicts,
  list_filter(['sql', 'building', 'spark'], lambda s: NOT contains(lower(c_mktsegment), s)) AS missing FROM customer LEFT JOIN m ON owner = c_custkey""")
def contradictions(spark, sf_dir):
    """A claimed grade against months worked, overlaps once; and skills that the text doesn't have."""
    m = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.countDistinct(F.trunc("o_orderdate", "month")).alias("months"))
    rows = table(spark, sf_dir, "customer").join(m, "c_custkey", "left")
    k, months = F.col("c_custkey") % 3, F.coalesce("months", F.lit(0))
    claimed, least = F.when(k == 0, "senior").when(k == 1, "middle").otherwise("junior"), F.when(k == 0, 12).when(k == 1, 5).otherwise(0)
    missing = F.filter(F.array(*map(F.lit, ("sql", "building", "spark"))), lambda s: ~F.contains(F.lower("c_mktsegment"), s))
    return rows.select(F.col("c_custkey").alias("owner"), months.alias("months"), claimed.alias("claimed"), (months < least).alias("contradicts"), missing.alias("missing"))


@query("Z30", "SELECT o_orderkey AS key, CASE WHEN c_custkey IS NULL THEN 'no company' WHEN c_acctbal < 0 THEN 'company is blocked' WHEN l.k IS NULL THEN 'no contact' WHEN o_totalprice < 50000 THEN 'score too low' ELSE 'ready' END AS state FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_quantity > 45) l ON l.k = o_orderkey")
def preconditions(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal", F.lit(True).alias("known"))
    li = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("contact", F.lit(True))
    rows = table(spark, sf_dir, "orders").join(c, "o_custkey", "left").join(li, "o_orderkey", "left")
    state = F.when(F.col("known").isNull(), "no company").when(F.col("c_acctbal") < 0, "company is blocked").when(F.col("contact").isNull(), "no contact").when(F.col("o_totalprice") < 50000, "score too low").otherwise("ready")
    return rows.select(F.col("o_orderkey").alias("key"), state.alias("state"))


@query("Z31", """
SELECT o_orderkey AS key, list_filter([c_name, 'nation ' || n_name, 'region ' || r_name, CASE WHEN k > 3 THEN 'lines ' || k END, CASE WHEN ret > 0 THEN 'returned ' || ret END, CASE WHEN seg IS NOT NULL THEN 'segment ' || seg END, CASE WHEN last IS NOT NULL THEN 'shipped ' || last END], lambda x: x IS NOT NULL) AS card
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT l_orderkey, count(*) AS k, sum((l_returnflag = 'R')::INT)::BIGINT AS ret, max(CAST(l_shipdate AS DATE)) AS last FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey LEFT JOIN (SELECT c_custkey AS ck, c_mktsegment AS seg FROM customer WHERE c_acctbal > 5000) ON ck = o_custkey""")
def cards(spark, sf_dir):
    """A record's card from seven lookups; those that find nothing leave no line."""
    t = lambda n: table(spark, sf_dir, n)
    li = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("l_returnflag") == "R").alias("ret"), F.max(F.to_date("l_shipdate")).alias("last"))
    who = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = t("orders").join(who, F.col("o_custkey") == F.col("c_custkey")).join(li, "o_orderkey", "left")
    line = lambda on, label, x: F.when(on, F.concat(F.lit(label), x.cast("string")))
    c = F.col
    return rows.select(c("o_orderkey").alias("key"), F.array_compact(F.array("c_name", F.concat(F.lit("nation "), "n_name"), F.concat(F.lit("region "), "r_name"), line(c("k") > 3, "lines ", c("k")), line(c("ret") > 0, "returned ", c("ret")), line(c("c_acctbal") > 5000, "segment ", c("c_mktsegment")), line(c("last").isNotNull(), "shipped ", c("last")))).alias("card"))


@query("Z32", """
WITH f AS (SELECT p_partkey AS part, 1 AS r, CASE WHEN p_partkey % 4 = 0 THEN p_size::BIGINT END AS id FROM part UNION ALL SELECT l_partkey, 2, min(l_suppkey) FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1 UNION ALL SELECT p_partkey, 3, s_suppkey FROM part JOIN supplier ON p_partkey % 100 = s_suppkey)
SELECT p_partkey AS part, arg_min(id, r) FILTER (id IS NOT NULL) AS employer FROM part LEFT JOIN f ON f.part = p_partkey GROUP BY 1""")
def employer_ids(spark, sf_dir):
    """An employer's id from three sources, the first that has one."""
    p = table(spark, sf_dir, "part")
    two = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min("l_suppkey").alias("two"))
    three = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_suppkey").alias("three"))
    rows = p.join(two, "p_partkey", "left").join(three, F.col("p_partkey") % 100 == F.col("k"), "left")
    return rows.select(F.col("p_partkey").alias("part"), F.coalesce(F.when(F.col("p_partkey") % 4 == 0, F.col("p_size").cast("long")), "two", "three").alias("employer"))


@query("Z34", r"""
WITH x AS (SELECT event_id, event_type AS field, CASE event_type WHEN 'view' THEN 'Remote' WHEN 'click' THEN round(value)::BIGINT::VARCHAR ELSE 'sql, spark' END AS source, CASE event_type WHEN 'view' THEN CASE event_id % 2 WHEN 0 THEN 'remote work' ELSE 'office' END WHEN 'click' THEN 'about ' || (round(value)::BIGINT + event_id % 2) ELSE CASE event_id % 3 WHEN 0 THEN 'Spark and SQL' ELSE 'java' END END AS said FROM events)
SELECT event_id, field, CASE field WHEN 'view' THEN contains(lower(said), lower(source)) WHEN 'click' THEN list_contains(regexp_extract_all(said, '[0-9]+'), source) ELSE len(list_filter(string_split(source, ', '), lambda s: contains(lower(said), s))) > 0 END AS agrees FROM x""")
def agreement(spark, sf_dir):
    """Whether what a text says agrees with what the source states, by kind of field: a word, a number, any of a list."""
    k, v = F.col("event_type"), F.round("value").cast("long")
    source = F.when(k == "view", "Remote").when(k == "click", v.cast("string")).otherwise("sql, spark")
    said = F.when(k == "view", F.when(F.col("event_id") % 2 == 0, "remote work").otherwise("office")).when(k == "click", F.concat(F.lit("about "), (v + F.col("event_id") % 2).cast("string"))).otherwise(F.when(F.col("event_id") % 3 == 0, "Spark and SQL").otherwise("java"))
    rows = table(spark, sf_dir, "events").select("event_id", k.alias("field"), source.alias("source"), said.alias("said"))
    low = F.lower("said")
    agrees = F.when(F.col("field") == "view", F.contains(low, F.lower("source"))).when(F.col("field") == "click", F.array_contains(F.regexp_extract_all("said", F.lit("[0-9]+"), F.lit(0)), F.col("source"))).otherwise(F.exists(F.split("source", ", "), lambda s: F.contains(low, s)))
    return rows.select("event_id", "field", agrees.alias("agrees"))


@query("Z37", r"""
WITH c AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z]{4,}') AS w, regexp_extract_all(text, '[0-9]+') AS n, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS asked, role FROM conversations), x AS (SELECT conv_id, turn, list_distinct(w) AS w, list_distinct(n) AS n, list_distinct(regexp_extract_all(lower(asked), '[a-z]{4,}')) AS aw, list_distinct(regexp_extract_all(asked, '[0-9]+')) AS an FROM c WHERE role = 'assistant' AND asked IS NOT NULL)
SELECT conv_id, turn, round(CASE WHEN len(aw) > 0 THEN len(list_intersect(w, aw)) / len(aw)::DOUBLE ELSE 0 END, 6) AS hit, len(list_filter(n, lambda i: NOT list_contains(an, i)))::INT AS invented FROM x""")
def answer_checks(spark, sf_dir):
    """The share of expected words that an answer has, and how many of its numbers were invented."""
    both = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").withColumn("asked", F.lag("text").over(both)).filter("role = 'assistant' and asked is not null")
    words = lambda x: F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit("[a-z]{4,}"), F.lit(0)))
    numbers = lambda x: F.array_distinct(F.regexp_extract_all(x, F.lit("[0-9]+"), F.lit(0)))
    rows = c.select("conv_id", "turn", words("text").alias("w"), numbers("text").alias("n"), words("asked").alias("aw"), numbers("asked").alias("an"))
    hit = F.when(F.size("aw") > 0, F.size(F.array_intersect("w", "aw")) / F.size("aw")).otherwise(F.lit(0.0))
    return rows.select("conv_id", "turn", F.round(hit, 6).alias("hit"), F.size(F.array_except("n", "an")).alias("invented"))
