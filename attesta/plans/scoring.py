"""Queries of scores: records against profiles, claims against history, contacts, and evidence of employers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.operators import injection as inj
from attesta.operators import reviews as R
from attesta.operators import scoring as S
from attesta.operators.approximate import terms_held
from attesta.plans import derived as D
from attesta.plans.employers import _FAKE, _HITS, _LOW, suspicious
from attesta.plans.registry import query
from attesta.plans.signals import _findings_sql
from attesta.sources.tables import NOW, now, table

# Records: orders, with titles, skills and pay that follow from their keys. Both engines read these expressions.
_VACANCY = [
    "o_orderkey AS key",
    "'firm ' || CAST(o_custkey % 23 AS STRING) AS company",
    "CASE o_orderkey % 6 WHEN 0 THEN 'senior sql developer' WHEN 1 THEN 'sales manger' WHEN 2 THEN 'data engineer' WHEN 3 THEN '' WHEN 4 THEN 'internship for students' ELSE 'office manger' END AS title",
    "CASE o_orderkey % 5 WHEN 0 THEN 'sql, spark and python every day' WHEN 1 THEN 'cold calls, shift work, a frendly team' WHEN 2 THEN 'python, airflow; remote' WHEN 3 THEN 'docker, sql, machne learning' ELSE 'a friendly team' END AS body",
    "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice END AS net",
    "CASE o_orderkey % 4 WHEN 1 THEN 'between1And3' WHEN 2 THEN 'moreThan6' ELSE '' END AS experience",
    "CASE o_orderpriority WHEN '1-URGENT' THEN 1.0 WHEN '2-HIGH' THEN 0.7 ELSE NULL END AS market",
]
PROFILES = [
    ("eng", ["sql", "spark", "python"], ["docker", "airflow", "machine learning"], ["internship", "cold calls"], ["developer", "engineer"], 150_000.0, True, ["between1And3"], True, 55.0, 10),
    ("mgr", ["friendly team"], [], ["shift work"], ["manager", "sales"], 0.0, False, [], False, 30.0, 0),
]
_PROFILE = "id string, skills array<string>, nice array<string>, stop_words array<string>, wanted array<string>, min_net double, allow_missing boolean, experience_ok array<string>, remote_ok boolean, min_score double, w_market int"


def _sql_list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]::VARCHAR[]"


_PROFILES_SQL = "(VALUES " + ", ".join(f"('{i}', {_sql_list(s)}, {_sql_list(n)}, {_sql_list(st)}, {_sql_list(w)}, {m}::DOUBLE, {a}, {_sql_list(e)}, {r}, {ms}::DOUBLE, {wm})" for i, s, n, st, w, m, a, e, r, ms, wm in PROFILES) + ") p(id, skills, nice, stop_words, wanted, min_net, allow_missing, experience_ok, remote_ok, min_score, w_market)"
FUZZY = 88.0  # the ratio from which a term counts as named
TERMS = sorted({t for p in PROFILES for t in (*p[1], *p[2], *p[4])})
_SHARE = "CASE WHEN len({0}) > 0 THEN len(list_filter({0}, lambda w: list_contains(coalesce(held, []), w))) / len({0})::DOUBLE ELSE 0 END"
# Terms that a text holds: of the shorter of both, each part of the longer that is as long, or cut by its ends.
_COMMON_SQL = "list_last(list_reduce(list_prepend(list_transform(range(0, length(p) + 1), lambda k: 0), list_transform(string_split(w, ''), lambda c: [ord(c)])), lambda row, x: list_prepend(0, list_transform(range(1, len(row)), lambda j: list_max(list_transform(range(1, j + 1), lambda i: greatest(row[i + 1], row[i] + (ord(p[i]) = x[1])::INT)))))))"
_HELD_SQL = f"""
th AS MATERIALIZED (SELECT DISTINCT text AS hay FROM vt UNION SELECT DISTINCT title FROM vt),
tp AS (SELECT hay, term, CASE WHEN length(term) <= length(hay) THEN term ELSE hay END AS p, CASE WHEN length(term) <= length(hay) THEN hay ELSE term END AS t FROM th CROSS JOIN (SELECT unnest({_sql_list(TERMS)}) AS term) WHERE hay <> ''),
tw AS MATERIALIZED (SELECT hay, term, p, substr(t, greatest(i, 1), CASE WHEN i < 1 THEN length(p) + i - 1 ELSE length(p) END) AS w FROM (SELECT *, unnest(range(2 - length(p), length(t) + 1)) AS i FROM tp)),
tl AS MATERIALIZED (SELECT p, w, {_COMMON_SQL} AS l FROM (SELECT DISTINCT p, w FROM tw WHERE 200 * length(w) >= {FUZZY} * (length(p) + length(w)) / 2)),
tf AS MATERIALIZED (SELECT hay, list(DISTINCT term) AS held FROM tw JOIN tl USING (p, w) WHERE 200.0 * l / (length(p) + length(w)) >= {FUZZY} - 1e-9 GROUP BY hay)"""
_W = S.WEIGHTS
_SCORES = rf"""
vc AS (SELECT {', '.join(_VACANCY)} FROM orders), vt AS (SELECT *, title || ' ' || body AS text, regexp_extract_all(title || ' ' || body, '[a-z0-9]+') AS tokens FROM vc),{_HELD_SQL},
vp AS (SELECT vt.*, a.held, coalesce(b.held, []) AS named, p.*, len(list_filter(stop_words, lambda w: CASE WHEN contains(w, ' ') THEN contains(text, w) ELSE len(list_filter(tokens, lambda t: starts_with(t, CASE WHEN length(w) >= 5 THEN substr(w, 1, length(w) - 1) ELSE w END))) > 0 END)) > 0 AS stop FROM vt LEFT JOIN tf a ON vt.text = a.hay LEFT JOIN tf b ON vt.title = b.hay CROSS JOIN {_PROFILES_SQL}),
vs AS (SELECT key, company, id AS profile, min_score, title, named, wanted, w_market, CASE WHEN stop THEN 'stop word' WHEN net IS NULL AND NOT allow_missing THEN 'no pay stated' WHEN min_net > 0 AND net < min_net * 0.85 THEN 'pay below the least' END AS reject,
  {_W['salary']} * CASE WHEN net IS NULL THEN 0.4 WHEN min_net > 0 AND net < min_net THEN 0.6 ELSE 1 END + {_W['skills']} * {_SHARE.format('skills')} + {_W['nice']} * {_SHARE.format('nice')}
  + CASE WHEN contains(text, 'remote') AND remote_ok THEN {_W['remote']} ELSE 0 END + {_W['experience']} * CASE WHEN NOT (len(experience_ok) > 0 AND experience <> '') THEN 0.5 WHEN list_contains(experience_ok, experience) THEN 1 ELSE 0 END
  + w_market * coalesce(market, 0) + CASE WHEN list_has_any(named, wanted) THEN {_W['title']} ELSE 0 END AS total FROM vp),
sc AS (SELECT key, company, profile, min_score, reject, CASE WHEN reject IS NOT NULL THEN 0.0 ELSE round(least(total, 100.0), 1) END AS score FROM vs)"""


def vacancies(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr(*_VACANCY).withColumn("text", F.concat("title", F.lit(" "), "body"))
    return rows.withColumn("held", terms_held(F.col("text"), TERMS, FUZZY)).withColumn("named", terms_held(F.col("title"), TERMS, FUZZY))


def _profiles(spark) -> DataFrame:
    return F.broadcast(spark.createDataFrame(PROFILES, _PROFILE))  # a configuration of a few rows


def scored(spark, sf_dir) -> DataFrame:
    """(key, company, profile, min_score, reject, score) of every record for every profile."""
    rows = vacancies(spark, sf_dir).withColumn("tokens", F.regexp_extract_all("text", F.lit("[a-z0-9]+"), F.lit(0))).crossJoin(_profiles(spark))
    weights = {k: F.lit(float(w)) for k, w in S.WEIGHTS.items()} | {"market": F.col("w_market")}
    c = F.col
    parts = S.points(c("held"), c("named"), c("net"), F.contains("text", F.lit("remote")) & c("remote_ok"), c("experience"), c("market"), c("skills"), c("nice"), c("wanted"), c("min_net"), c("experience_ok"), weights)
    reject = F.when(S.stopped(c("tokens"), c("text"), c("stop_words")), "stop word").when(c("net").isNull() & ~c("allow_missing"), "no pay stated").when((c("min_net") > 0) & (c("net") < c("min_net") * 0.85), "pay below the least")
    total = F.round(F.least(sum(parts.values(), F.lit(0.0)), F.lit(100.0)), 1)
    judged = rows.select("key", "company", c("id").alias("profile"), "min_score", reject.alias("reject"), total.alias("total"))
    return judged.select("key", "company", "profile", "min_score", "reject", F.when(c("reject").isNotNull(), 0.0).otherwise(c("total")).alias("score"))


@query("C7", f"WITH {_SCORES} SELECT key, profile, score, reject FROM sc")
def all_profiles(spark, sf_dir):
    return scored(spark, sf_dir).select("key", "profile", "score", "reject")


@query("T45", f"WITH {_SCORES} SELECT key, arg_max(score, (score, profile)) AS score, arg_max(profile, (score, profile)) AS profile FROM sc WHERE reject IS NULL GROUP BY key")
def best_scores(spark, sf_dir):
    best = scored(spark, sf_dir).filter("reject is null").groupBy("key").agg(F.max(F.struct("score", "profile")).alias("b"))
    return best.select("key", "b.score", "b.profile")


@query("Z20", f"WITH {_SCORES} SELECT key, list_sort(list(profile)) AS profiles, (SELECT min(min_score) FROM sc) AS least FROM sc WHERE reject IS NULL AND score >= min_score GROUP BY key")
def passed_profiles(spark, sf_dir):
    """The profiles whose own threshold a record passes, and the lowest threshold of all."""
    least = min(p[9] for p in PROFILES)
    ok = scored(spark, sf_dir).filter("reject is null and score >= min_score")
    return ok.groupBy("key").agg(F.array_sort(F.collect_list("profile")).alias("profiles")).withColumn("least", F.lit(least))


@query("P14_ceiling", f"WITH {_SCORES} SELECT key, profile, round(least(100.0, {sum(_W.values()) - _W['title']} + w_market + CASE WHEN len(wanted) = 0 OR title = '' OR list_has_any(named, wanted) THEN {_W['title']} ELSE 0 END), 1)::DOUBLE AS most FROM vs")
def ceilings(spark, sf_dir):
    rows = vacancies(spark, sf_dir).crossJoin(_profiles(spark))
    weights = {k: F.lit(float(w)) for k, w in S.WEIGHTS.items()} | {"market": F.col("w_market").cast("double")}
    return rows.select("key", F.col("id").alias("profile"), S.ceiling(F.col("title"), F.col("named"), F.col("wanted"), weights).alias("most"))


@query("M18", """
WITH c AS (SELECT user_id AS id, event_type AS k, count(*)::DOUBLE AS v FROM events GROUP BY ALL), x AS (SELECT id, k, v * 100 / sum(v) OVER (PARTITION BY id) AS x FROM c),
r AS (SELECT *, floor(x)::BIGINT AS base, row_number() OVER (PARTITION BY id ORDER BY x - floor(x) DESC, k) AS r, 100 - sum(floor(x)) OVER (PARTITION BY id) AS rest FROM x)
SELECT id, k AS criterion, CASE WHEN r <= rest THEN base + 1 ELSE base END AS weight FROM r""")
def normalised_weights(spark, sf_dir):
    """Weights of each owner as whole numbers that add up to 100: the largest remainders are rounded up."""
    w = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id"), F.col("event_type").alias("criterion")).agg(F.count(F.lit(1)).cast("double").alias("v"))
    own = Window.partitionBy("id")
    x = w.withColumn("x", F.col("v") * 100 / F.sum("v").over(own)).withColumn("base", F.floor("x").cast("long"))
    ranked = x.withColumn("r", F.row_number().over(own.orderBy(F.desc(F.col("x") - F.col("base")), "criterion"))).withColumn("rest", 100 - F.sum("base").over(own))
    return ranked.select("id", "criterion", (F.col("base") + (F.col("r") <= F.col("rest")).cast("long")).alias("weight"))


# Claims --------------------------------------------------------------------------------------------------------------

_AT = lambda patterns: "coalesce(" + ", ".join(f"nullif(strpos(lower(text), '{p}'), 0)" for p in patterns) + ")"
_CLAIMS_SQL = "cl AS (" + " UNION ALL ".join(f"SELECT doc_id, text, '{kind}' AS kind, {_AT(patterns)} AS pos FROM {D.CLAIMS_SQL} WHERE {_AT(patterns)} IS NOT NULL" for kind, patterns in S.CLAIMS) + ")"


@query("T21", rf"WITH {_CLAIMS_SQL} SELECT doc_id, kind, trim(regexp_replace(substr(text, greatest(pos - 45, 1)::BIGINT, (pos - greatest(pos - 45, 1) + 90)::BIGINT), '\s+', ' ', 'g')) AS quote FROM cl")
def claims(spark, sf_dir):
    return D.claims(spark, sf_dir).select("doc_id", F.explode(S.claims_of(F.col("text"))).alias("c")).select("doc_id", "c.kind", "c.quote")


_HISTORY = """hs AS (SELECT user_id AS doc_id, floor(epoch(max(date_trunc('second', ts)) - min(date_trunc('second', ts))) / 86400)::BIGINT AS days, count(DISTINCT CAST(ts AS DATE)) AS published, sum((event_type = 'purchase')::INT)::BIGINT AS changes FROM events GROUP BY 1)"""


@query("T22", f"""
WITH {_CLAIMS_SQL}, {_HISTORY}, x AS (SELECT cl.doc_id, kind, regexp_matches(text, '(?i){'|'.join(S.OVERTIME)}') AS hint, coalesce(days, 0) AS days, coalesce(published, 0) AS published, coalesce(changes, 0) AS changes, cl.doc_id % 3 = 0 AS nopay, CASE WHEN coalesce(days, 0) >= 60 THEN 'high' WHEN coalesce(days, 0) >= 14 THEN 'middle' ELSE 'low' END AS hist FROM cl LEFT JOIN hs USING (doc_id))
SELECT doc_id, kind, CASE kind WHEN 'stable_team' THEN CASE WHEN days < 14 THEN 'no_data' WHEN published >= 3 THEN 'not_supported' ELSE 'supported' END WHEN 'no_overtime' THEN CASE WHEN hint THEN 'not_supported' ELSE 'no_data' END WHEN 'white_salary' THEN CASE WHEN nopay THEN 'not_supported' WHEN changes > 0 THEN 'no_data' ELSE 'supported' END ELSE 'no_data' END AS verdict,
  CASE kind WHEN 'stable_team' THEN hist WHEN 'no_overtime' THEN CASE WHEN hint THEN 'middle' ELSE 'low' END WHEN 'white_salary' THEN CASE WHEN nopay THEN 'middle' ELSE hist END ELSE 'low' END AS confidence FROM x""")
def claim_verdicts(spark, sf_dir):
    said = D.claims(spark, sf_dir).select("doc_id", "text", F.explode(S.claims_of(F.col("text"))).alias("c"))
    history = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("doc_id")).agg(F.floor((F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))) / 86400).alias("days"), F.countDistinct(F.to_date("ts")).alias("published"), F.count_if(F.col("event_type") == "purchase").alias("changes"))
    rows = said.join(history, "doc_id", "left").fillna(0, ["days", "published", "changes"]).withColumn("low", F.when(F.col("doc_id") % 3 != 0, 1.0))
    out, sure = S.verdict(F.col("c.kind"), *(F.col(c) for c in ("text", "low", "low", "days", "published", "changes")))
    return rows.select("doc_id", "c.kind", out.alias("verdict"), sure.alias("confidence"))


_DUTIES = [" Architecture, roadmap and mentoring.", " Strategy and budget.", " Mentoring, strategy, budget, roadmap."]


@query("T22_facts", f"""
WITH h AS (SELECT o_custkey AS id, min(o_totalprice) AS low, max(o_totalprice) AS high, date_diff('day', min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE))) AS days, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) = 'O' AS active FROM orders GROUP BY 1),
x AS (SELECT h.*, h.id % 4 = 0 AS junior, lower(coalesce(text, '') || {D.chosen('h.id', _DUTIES)}) AS t FROM h LEFT JOIN documents ON doc_id = h.id)
SELECT id, 'pay_band_wide' AS kind, 'high' AS confidence FROM x WHERE low > 0 AND high >= 2 * low
UNION ALL SELECT id, 'grade_mismatch', 'middle' FROM x WHERE junior AND {' + '.join(f"contains(t, '{t}')::INT" for t in S.SENIOR)} >= 3
UNION ALL SELECT id, 'long_running', 'high' FROM x WHERE active AND days >= 90""")
def numeric_facts(spark, sf_dir):
    """Facts without claims of each customer's record: the band of its orders' prices, the days they span, its text's terms."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(
        F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"), F.datediff(F.max(F.to_date("o_orderdate")), F.min(F.to_date("o_orderdate"))).alias("days"),
        (F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")) == "O").alias("active"))
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    rows = o.join(texts, "id", "left").withColumn("text", F.concat(F.coalesce("text", F.lit("")), D.spark_text("id", _DUTIES)))
    found = S.facts(F.col("low"), F.col("high"), F.col("id") % 4 == 0, F.col("text"), F.col("days"), F.col("active"))
    return rows.select("id", F.explode(found).alias("f")).select("id", "f.kind", "f.confidence")


# Contacts ------------------------------------------------------------------------------------------------------------

_CONTACT = "CASE doc_id % 7 WHEN 0 THEN ' Write to hr@firm' || CAST(doc_id AS STRING) || '.example.com. Ask Anna Smith, Head of data.' WHEN 1 THEN ' Team lead is John Brown. See https://t.me/jobs_chat or github.com/some-login' WHEN 2 THEN ' info@shop.example, +1 555 010 2030' WHEN 3 THEN ' Ann.Lee@shop.example and ann.lee@shop.example. Director Mary Jane Watson' ELSE '' END"
_TALK = f"(SELECT doc_id, text || {_CONTACT} AS text FROM documents)"
_CHANNELS = rf"""
c0 AS (SELECT doc_id, 'email' AS kind, unnest(list_distinct(list_transform(regexp_extract_all(text, '{S.EMAIL}'), lambda v: lower(v)))) AS value FROM {_TALK}
  UNION ALL SELECT doc_id, 'telegram', unnest(list_distinct(list_transform(regexp_extract_all(text, '{S.TELEGRAM}', 1), lambda v: lower(v)))) FROM {_TALK}
  UNION ALL SELECT doc_id, 'github', unnest(list_distinct(list_transform(regexp_extract_all(text, '{S.GITHUB}', 1), lambda v: lower(v)))) FROM {_TALK}),
ch AS (SELECT doc_id, kind, value, CASE WHEN kind <> 'email' THEN 6 WHEN regexp_extract(value, '^([^@._+-]*)', 1) IN ({', '.join(f"'{b}'" for b in S.HR_BOXES)}) THEN 8 WHEN regexp_extract(value, '^([^@._+-]*)', 1) IN ({', '.join(f"'{b}'" for b in S.COMMON_BOXES)}) THEN 7 ELSE 5 END AS rank FROM c0 WHERE length(value) <= 254)"""
_LEADS = r"""
n0 AS (SELECT doc_id, unnest(string_split_regex(text, '[.!?\n]+')) AS s FROM {talk}), n1 AS (SELECT doc_id, s, ' ' || trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) || ' ' AS p FROM n0),
n2 AS (SELECT doc_id, s, CASE WHEN contains(p, ' head of ') OR contains(p, ' director ') THEN 1 WHEN contains(p, ' lead ') OR contains(p, ' team lead ') THEN 2 WHEN contains(p, ' manager ') THEN 3 END AS rank FROM n1),
ld AS (SELECT doc_id, name, min(rank)::INT AS rank FROM (SELECT doc_id, rank, unnest(regexp_extract_all(s, '\b([A-Z][a-z]{2,} [A-Z][a-z]{2,})\b', 1)) AS name FROM n2 WHERE rank IS NOT NULL) GROUP BY ALL)""".replace("{talk}", _TALK)


def _talk(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr("doc_id", f"text || {_CONTACT} AS text")


@query("T31", f"WITH {_CHANNELS} SELECT doc_id, kind, value, rank::INT AS rank FROM ch")
def contacts(spark, sf_dir):
    return _talk(spark, sf_dir).select("doc_id", F.explode(S.channels(F.col("text"))).alias("c")).select("doc_id", "c.kind", "c.value", "c.rank")


@query("T31_refused", rf"""
SELECT doc_id, 'phone' AS kind, unnest(regexp_extract_all(text, '{S.PHONE}')) AS value FROM {_TALK}
UNION ALL SELECT doc_id, 'host', h FROM {_TALK} JOIN (SELECT unnest([{', '.join(f"'{h}'" for h in S.PERSONAL_HOSTS)}]) AS h) ON contains(lower(text), h)""")
def refused_contacts(spark, sf_dir):
    """Phones and personal pages, which are no working channels, of every text."""
    return _talk(spark, sf_dir).select("doc_id", F.explode(S.refused(F.col("text"))).alias("c")).select("doc_id", "c.kind", "c.value")


@query("T32", f"WITH {_LEADS} SELECT doc_id, name, rank FROM ld")
def lead_names(spark, sf_dir):
    return S.leads(_talk(spark, sf_dir), "doc_id", "text")


_NAMES = [("Анна", "Смирнова"), ("Юрий", "Щукин"), ("John", "O'Neil"), ("Zoë", "Müller")]


@query("T33", """
SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN ['anna.smirnova@d.example', 'a.smirnova@d.example', 'asmirnova@d.example', 'anna@d.example'] WHEN 1 THEN ['yuriy.schukin@d.example', 'y.schukin@d.example', 'yschukin@d.example', 'yuriy@d.example']
  WHEN 2 THEN ['john.o''neil@d.example', 'j.o''neil@d.example', 'jo''neil@d.example', 'john@d.example'] ELSE ['zo.mller@d.example', 'z.mller@d.example', 'zmller@d.example', 'zo@d.example'] END AS mails FROM supplier""")
def guessed(spark, sf_dir):
    first, last = (F.element_at(F.array(*(F.lit(n[k]) for n in _NAMES)), (F.col("s_suppkey") % 4 + 1).cast("int")) for k in (0, 1))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), S.guessed_mails(first, last, F.lit("d.example")).alias("mails"))


@query("Z29", f"""
WITH {_CHANNELS}, {_LEADS}, best AS (SELECT doc_id, arg_min(name, (rank, name)) AS lead FROM ld GROUP BY 1)
SELECT doc_id, place::INT AS place, kind, value, lead FROM (SELECT ch.*, row_number() OVER (PARTITION BY ch.doc_id ORDER BY rank, kind, value) AS place FROM ch) LEFT JOIN best USING (doc_id) WHERE place <= 3""")
def discovered(spark, sf_dir):
    """Of each text the three best channels, and with them the name of the highest lead."""
    rows = _talk(spark, sf_dir)
    ch = rows.select("doc_id", F.explode(S.channels(F.col("text"))).alias("c")).select("doc_id", "c.*")
    lead = S.leads(rows, "doc_id", "text").groupBy("doc_id").agg(F.min_by("name", F.struct("rank", "name")).alias("lead"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("rank", "kind", "value"))
    return ch.withColumn("place", place).filter("place <= 3").join(lead, "doc_id", "left").select("doc_id", "place", "kind", "value", "lead")


@query("P20", f"""
WITH e AS (SELECT event_id, user_id, ts, event_type FROM events), b AS (SELECT DISTINCT user_id FROM e WHERE event_type = 'error'), r AS (SELECT DISTINCT user_id FROM e WHERE event_type = 'purchase' AND ts >= TIMESTAMP '{NOW}' - INTERVAL 10 DAY)
SELECT event_id, user_id IN (SELECT user_id FROM b) AS blocked, user_id IN (SELECT user_id FROM r) AS recent, event_type = 'click' AND ts <= TIMESTAMP '{NOW}' - INTERVAL 7 DAY AND user_id NOT IN (SELECT user_id FROM r) AS due FROM e""")
def contact_rules(spark, sf_dir):
    """Whether a contact is refused for good, was written to lately, or is due to be followed up."""
    e = table(spark, sf_dir, "events")
    blocked = e.filter("event_type = 'error'").select("user_id").distinct().withColumn("b", F.lit(True))
    recent = e.filter((F.col("event_type") == "purchase") & (F.col("ts") >= now() - F.expr("INTERVAL 10 DAYS"))).select("user_id").distinct().withColumn("r", F.lit(True))
    rows = e.join(blocked, "user_id", "left").join(recent, "user_id", "left")
    due = (F.col("event_type") == "click") & (F.col("ts") <= now() - F.expr("INTERVAL 7 DAYS")) & F.col("r").isNull()
    return rows.select("event_id", F.col("b").isNotNull().alias("blocked"), F.col("r").isNotNull().alias("recent"), due.alias("due"))


# Evidence ------------------------------------------------------------------------------------------------------------

_SITE_TRUST = {"forum": 0.5, "web": 0.7, "news": 0.9}
_TRUST_SQL = "round(0.8 * CASE rv.site WHEN 'forum' THEN 0.5 WHEN 'web' THEN 0.7 WHEN 'news' THEN 0.9 ELSE 0.6 END * CASE label WHEN 'clean' THEN 1.0 WHEN 'suspect' THEN 0.5 ELSE 0 END, 9)"
_AXIS_SQL = "CASE code " + " ".join(f"WHEN '{c}' THEN '{a}'" for c, a in S.PATTERN_AXIS.items()) + " END"
_EV_REVIEWS = f"er AS (SELECT hits.company, code, {_AXIS_SQL} AS axis, polarity, weight, {_TRUST_SQL.replace('rv.', 'hits.')} AS trust, hits.dated_at AS observed FROM hits JOIN fv USING (doc_id) WHERE label <> 'fake')"


def review_evidence(rows: DataFrame, judged: DataFrame | None = None) -> DataFrame:
    """(company, code, axis, polarity, weight, trust, observed): a row per pattern of a review that isn't bought; judged: suspicious(rows), if known."""
    label = (suspicious(rows) if judged is None else judged).select("doc_id", "label")
    trust = F.create_map(*(F.lit(x) for kv in _SITE_TRUST.items() for x in kv))
    meta = F.create_map(*(x for c, p, w, _ in R.PATTERNS for x in (F.lit(c), F.struct(F.lit(p).alias("p"), F.lit(w).alias("w"), F.lit(S.PATTERN_AXIS[c]).alias("a")))))
    said = rows.join(label.filter("label <> 'fake'"), "doc_id").select("company", "site", "dated_at", "label", F.explode(R.pattern_codes(F.col("text"))).alias("code")).withColumn("m", meta[F.col("code")])
    weight = F.when(F.col("label") == "clean", 1.0).otherwise(0.5)
    return said.select("company", "code", F.col("m.a").alias("axis"), F.col("m.p").alias("polarity"), F.col("m.w").alias("weight"), F.round(0.8 * F.coalesce(trust[F.col("site")], F.lit(0.6)) * weight, 9).alias("trust"), F.col("dated_at").alias("observed"))


@query("Z1", f"WITH {_FAKE}, rv AS {_LOW}, hits AS ({_HITS}), {_EV_REVIEWS} SELECT company, code, axis, polarity, weight::INT AS weight, trust::DOUBLE AS trust, observed FROM er")
def evidence_of_reviews(spark, sf_dir):
    return review_evidence(D.reviews(spark, sf_dir))


_COMPANY_OF = "'Firm ' || CAST({} % 23 AS STRING)"
_EV_INJECTION = f"{_findings_sql(D.ATTACKS_SQL, 'doc_id')}, ei AS (SELECT company, 'injection' AS code, 'truth' AS axis, 'red' AS polarity, 3 AS weight, 1.0 AS trust, NULL::DATE AS observed FROM (SELECT {_COMPANY_OF.format('doc_id')} AS company, doc_id, row_number() OVER (PARTITION BY doc_id % 23 ORDER BY doc_id DESC) AS r FROM (SELECT DISTINCT doc_id FROM found WHERE level = 'red')) WHERE r <= 5)"
_EV_DEEP = f"ed AS (SELECT {_COMPANY_OF.format('user_id')} AS company, event_type AS code, 'truth' AS axis, 'red' AS polarity, 1 AS weight, 0.6 AS trust, CAST(ts AS DATE) AS observed FROM events WHERE event_type NOT IN ('view', 'click'))"


def injection_evidence(spark, sf_dir) -> DataFrame:
    """Of each company the five latest texts with a red finding of the injection scan."""
    red = inj.findings(D.attacked(spark, sf_dir), "doc_id", "text").filter("level = 'red'").select("doc_id").distinct()
    hit = red.selectExpr(f"{_COMPANY_OF.format('doc_id')} AS company", "doc_id")
    last = hit.withColumn("r", F.row_number().over(Window.partitionBy("company").orderBy(F.desc("doc_id")))).filter("r <= 5")
    return last.select("company", F.lit("injection").alias("code"), F.lit("truth").alias("axis"), F.lit("red").alias("polarity"), F.lit(3).alias("weight"), F.lit(1.0).alias("trust"), F.lit(None).cast("date").alias("observed"))


def deep_evidence(spark, sf_dir) -> DataFrame:
    """Findings of research, but for those of topics that only look things up."""
    e = table(spark, sf_dir, "events").filter("event_type not in ('view', 'click')")
    return e.selectExpr(f"{_COMPANY_OF.format('user_id')} AS company", "event_type AS code", "'truth' AS axis", "'red' AS polarity", "1 AS weight", "CAST(0.6 AS DOUBLE) AS trust", "CAST(ts AS DATE) AS observed")


@query("Z4", f"WITH {_EV_INJECTION}, {_EV_DEEP} SELECT company, code, weight::INT AS weight, trust::DOUBLE AS trust, observed FROM (SELECT * FROM ei UNION ALL SELECT * FROM ed)")
def other_evidence(spark, sf_dir):
    both = injection_evidence(spark, sf_dir).unionByName(deep_evidence(spark, sf_dir))
    return both.select("company", "code", "weight", "trust", "observed")


_OWN = {"republished": ("churn", 3), "no_salary": ("pay", 2), "salary_moved": ("truth", 2)}
_EV_OWN = f"""eo AS (SELECT company, code, CASE code WHEN 'republished' THEN 'churn' WHEN 'no_salary' THEN 'pay' ELSE 'truth' END AS axis, 'red' AS polarity, CASE code WHEN 'republished' THEN 3 ELSE 2 END AS weight, 1.0 AS trust, NULL::DATE AS observed
  FROM (SELECT {_COMPANY_OF.format('o_custkey')} AS company, sum((o_orderstatus = 'P')::INT) AS republished, sum((o_totalprice < 50000)::INT) AS no_salary, sum((o_orderpriority = '1-URGENT')::INT) AS salary_moved, count(*) AS total FROM orders GROUP BY 1) UNPIVOT (n FOR code IN (republished, no_salary, salary_moved)) WHERE n * 5 >= total)"""
_EV_MARKET = f"em AS (SELECT company, CASE WHEN d < -0.02 THEN 'below' ELSE 'above' END AS code, CASE WHEN d < -0.02 THEN 'pay' ELSE 'truth' END AS axis, 'red' AS polarity, 2 AS weight, 1.0 AS trust, NULL::DATE AS observed FROM (SELECT {_COMPANY_OF.format('o_custkey')} AS company, round(avg(o_totalprice) / (SELECT avg(o_totalprice) FROM orders) - 1, 9) AS d FROM orders GROUP BY 1) WHERE abs(d) > 0.02)"
_EV_VACANCY = f"ey AS (SELECT {_COMPANY_OF.format('doc_id')} AS company, 'stable_team' AS code, 'churn' AS axis, 'red' AS polarity, 4 AS weight, 1.0 AS trust, NULL::DATE AS observed FROM documents WHERE doc_id % 7 = 0 AND doc_id % 11 = 0)"
_COMBOS = [(("republished", "fired"), "churn", 5), (("no_salary", "below"), "pay", 4), (("stable_team", "republished"), "truth", 4)]
_VETO = ("late_salary", ("injection", "fired"))
_EV_ALL = "ea AS (" + " UNION ALL ".join(f"SELECT company, code, axis, polarity, weight, trust::DOUBLE AS trust, observed FROM {t}" for t in ("er", "eo", "em", "ey", "ei", "ed")) + ")"
_COMBO_SQL = "ec AS (" + " UNION ALL ".join(f"SELECT company, '{'+'.join(n)}' AS code, '{a}' AS axis, 'red' AS polarity, {w} AS weight, 1.0::DOUBLE AS trust, NULL::DATE AS observed FROM ea GROUP BY company HAVING {' AND '.join(f'bool_or(code = {chr(39)}{c}{chr(39)})' for c in n)}" for n, a, w in _COMBOS) + ")"
_LEVELS = f"""
{_FAKE}, rv AS {_LOW}, hits AS ({_HITS}), {_EV_REVIEWS}, {_EV_OWN}, {_EV_MARKET}, {_EV_VACANCY}, {_EV_INJECTION}, {_EV_DEEP}, {_EV_ALL}, {_COMBO_SQL},
ew AS (SELECT *, weight * trust * coalesce(exp(-greatest(date_diff('day', observed, DATE '{NOW[:10]}') / 30.0, 0) / 18), 1) AS v FROM (SELECT * FROM ea UNION ALL SELECT * FROM ec)),
ax AS (SELECT company, axis, round(100 * (1 - exp(-coalesce(sum(v) FILTER (polarity = 'red'), 0) / 6)) - least(40, 100 * (1 - exp(-coalesce(sum(v) FILTER (polarity = 'green'), 0) / 6))), 1) AS value, count(*) >= 2 OR bool_or(trust >= 0.8) AS covered FROM ew GROUP BY ALL),
wo AS (SELECT company, count(*) FILTER (covered) AS n, max(CASE WHEN value >= 50 THEN 2 WHEN value >= 20 THEN 1 ELSE 0 END) FILTER (covered) AS worst, string_agg(axis || '=' || printf('%.1f', value), ',' ORDER BY axis) AS axes FROM ax GROUP BY 1),
ve AS (SELECT company, count(*) FILTER (code = 'late_salary' AND trust > 0) >= 2 OR coalesce(bool_or(code = 'late_salary' AND trust >= 1), false) AS red, min(code) FILTER (code IN ('injection', 'fired')) AS yellow FROM ew GROUP BY 1),
lv AS (SELECT company, CASE WHEN red THEN 2 WHEN yellow IS NOT NULL AND (n < 2 OR worst < 1) THEN 1 WHEN n < 2 THEN -1 ELSE worst END AS level, CASE WHEN red THEN 'late_salary' ELSE coalesce(yellow, '') END AS veto, axes FROM wo JOIN ve USING (company))"""


def every_evidence(spark, sf_dir, judged: DataFrame | None = None) -> DataFrame:
    """Evidence of six sources: reviews, own counters, the market, records' claims, injections and research."""
    o = table(spark, sf_dir, "orders").selectExpr("*", f"{_COMPANY_OF.format('o_custkey')} AS company")
    counts = o.groupBy("company").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("o_orderstatus") == "P").alias("republished"), F.count_if(F.col("o_totalprice") < 50000).alias("no_salary"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("salary_moved"), F.avg("o_totalprice").alias("mean"))
    shape = lambda code, axis, weight: (code.alias("code"), axis.alias("axis"), F.lit("red").alias("polarity"), weight.alias("weight"), F.lit(1.0).alias("trust"), F.lit(None).cast("date").alias("observed"))
    meta = F.create_map(*(x for k, (a, w) in _OWN.items() for x in (F.lit(k), F.struct(F.lit(a).alias("a"), F.lit(w).alias("w")))))
    own = counts.unpivot(["company", "total"], list(_OWN), "kind", "n").filter("n * 5 >= total").select("company", *shape(F.col("kind"), meta[F.col("kind")]["a"], meta[F.col("kind")]["w"]))
    mean = o.agg(F.avg("o_totalprice").alias("all"))  # one row
    d = F.round(F.col("mean") / F.col("all") - 1, 9)
    market = counts.crossJoin(F.broadcast(mean)).withColumn("d", d).filter("abs(d) > 0.02").select("company", *shape(F.when(F.col("d") < -0.02, "below").otherwise("above"), F.when(F.col("d") < -0.02, "pay").otherwise("truth"), F.lit(2)))
    claimed = table(spark, sf_dir, "documents").filter("doc_id % 7 = 0 and doc_id % 11 = 0").selectExpr(f"{_COMPANY_OF.format('doc_id')} AS company").select("company", *shape(F.lit("stable_team"), F.lit("churn"), F.lit(4)))
    out = review_evidence(D.reviews(spark, sf_dir), judged)
    for more in (own, market, claimed, injection_evidence(spark, sf_dir), deep_evidence(spark, sf_dir)):
        out = out.unionByName(more)
    return out


@query("A37", f"WITH {_LEVELS} SELECT company, CASE level WHEN -1 THEN 'unknown' WHEN 0 THEN 'green' WHEN 1 THEN 'yellow' ELSE 'red' END AS level, veto, axes FROM lv")
def company_score(spark, sf_dir):
    return S.company_levels(every_evidence(spark, sf_dir), now(), _COMBOS, *_VETO)


@query("N10_top", f"WITH {_LEVELS}, t AS (SELECT company, code, max(weight * trust) AS v FROM ea WHERE polarity = 'red' GROUP BY ALL) SELECT company, row_number() OVER (PARTITION BY company ORDER BY v DESC, code)::INT AS place, code FROM t QUALIFY place <= 3")
def top_codes(spark, sf_dir):
    return S.top_evidence(every_evidence(spark, sf_dir))


@query("C1", f"WITH {_LEVELS}, {_SCORES} SELECT 'market' AS step, (SELECT count(*) FROM em) AS n UNION ALL SELECT 'reviews', (SELECT count(*) FROM fv) UNION ALL SELECT 'companies', (SELECT count(*) FROM lv) UNION ALL SELECT 'scores', (SELECT count(*) FROM sc)")
def rebuilt(spark, sf_dir):
    """Derived tables rebuilt in order, each written before the next reads: the market's and reviews' evidence, companies, scores."""
    from attesta.streaming.events import shared

    path = shared(spark)

    def step(name: str, rows: DataFrame) -> DataFrame:
        rows.write.mode("overwrite").parquet(f"{path}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{path}/{name}")

    judged = step("reviews", suspicious(D.reviews(spark, sf_dir)))
    evidence = step("evidence", every_evidence(spark, sf_dir, judged))
    levels = step("companies", S.company_levels(evidence, now(), _COMBOS, *_VETO))
    scores = step("scores", scored(spark, sf_dir))
    out = None
    for name, rows in (("market", evidence.filter("code in ('below', 'above')")), ("reviews", judged), ("companies", levels), ("scores", scores)):
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("step"), "n")
        out = one if out is None else out.unionByName(one)
    return out

