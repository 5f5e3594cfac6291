"""Queries of reviews and employers: names, patterns, areas, legitimacy, bought reviews and risk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.functions import text as T
from attesta.operators import names
from attesta.operators import reviews as R
from attesta.operators.approximate import name_held
from attesta.plans import derived as D
from attesta.plans.registry import query
from attesta.plans.signals import _CODES, _SIGNALS, signal_codes
from attesta.sources.tables import table
from attesta.streaming.events import written

# Names ---------------------------------------------------------------------------------------------------------------

_SUP = "(SELECT s_suppkey, regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g') AS name FROM supplier)"
_CLAIMED = "CASE c_custkey % 3 WHEN 0 THEN 'supplier 00000' || lpad(CAST(c_custkey % 150 AS STRING), 4, '0') WHEN 1 THEN 'suplier 00000' || lpad(CAST(c_custkey % 150 AS STRING), 4, '0') ELSE 'nobody ' || CAST(c_custkey % 17 AS STRING) END"
_CUT = "(SELECT name, substr(w, 1, i - 1) || substr(w, i + 1) AS v FROM (SELECT name, w, unnest(range(1, length(w) + 1)) AS i FROM (SELECT name, array_to_string(list_sort(string_split(name, ' ')), ' ') AS w FROM {})))"
_CUTS = _CUT.format(_SUP)


def _suppliers(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", names.plain_name(F.col("s_name")).alias("name"))


_VARIED = "CASE s_suppkey % 5 WHEN 1 THEN replace(name, 'pp', 'p') WHEN 2 THEN name || '7' WHEN 3 THEN replace(name, 'supplier', 'zupplierz') ELSE name END"
_SORTED = "array_to_string(list_sort(string_split(name, ' ')), ' ')"
_LCS = "list_last(list_reduce(list_prepend(list_transform(range(0, length(y) + 1), lambda k: 0), list_transform(string_split(x, ''), lambda c: [ord(c)])), lambda row, z: list_prepend(0, list_transform(range(1, len(row)), lambda j: list_max(list_transform(range(1, j + 1), lambda i: greatest(row[i + 1], row[i] + (ord(y[i]) = z[1])::INT)))))))"


@query("J21", f"""
WITH v AS MATERIALIZED (SELECT DISTINCT name, {_SORTED} AS w FROM (SELECT {_VARIED} AS name FROM {_SUP})),
c AS MATERIALIZED (SELECT a.name AS a, b.name AS b, a.w AS x, b.w AS y FROM v a JOIN v b ON a.name <= b.name AND 200.0 * least(length(a.w), length(b.w)) >= 92 * (length(a.w) + length(b.w))),
r AS (SELECT a, b, round(200.0 * {_LCS} / (length(x) + length(y)), 4) AS ratio FROM c)
SELECT a, b, ratio::DOUBLE AS ratio FROM r WHERE ratio >= 92""")
def same_names(spark, sf_dir):
    """Suppliers' names, some a letter shorter or longer, whose sorted words are 92 or more alike."""
    n = _suppliers(spark, sf_dir).selectExpr(f"{_VARIED} AS name")
    return names.similar_names(n, n).filter("a <= b")


@query("J22", f"WITH v AS {_CUTS}, o AS {_CUT.format(chr(40) + 'SELECT ' + repr('supplier 000000012') + ' AS name)')} SELECT s_suppkey, name FROM {_SUP} WHERE name IN (SELECT v.name FROM v JOIN o ON v.v = o.v)")
def same_company_rows(spark, sf_dir):
    rows = _suppliers(spark, sf_dir)
    like = names.similar_names(rows.select("name"), spark.createDataFrame([("supplier 000000012",)], "name string"))
    return rows.join(like.select(F.col("a").alias("name")), "name", "left_semi").select("s_suppkey", "name")


@query("J23", f"""
WITH c AS (SELECT DISTINCT {_CLAIMED} AS name FROM customer), v AS {_CUTS}, cv AS {_CUT.format("c")},
n0 AS (SELECT c.name, v.name AS near, 1 AS r FROM c JOIN v ON array_to_string(list_sort(string_split(c.name, ' ')), ' ') = v.v UNION ALL SELECT cv.name, v.name, 2 FROM cv JOIN v ON cv.v = v.v),
n AS (SELECT name, near FROM n0 QUALIFY row_number() OVER (PARTITION BY name ORDER BY r, near) = 1)
SELECT c.name, coalesce(s.name, near, c.name) AS found FROM c LEFT JOIN (SELECT DISTINCT name FROM {_SUP}) s ON c.name = s.name LEFT JOIN n ON c.name = n.name""")
def canonical_names(spark, sf_dir):
    """A claimed name of one letter less than a known one has a ratio of 97, one with another letter 94; two letters apart: below 92."""
    return names.resolved(table(spark, sf_dir, "customer").selectExpr(f"{_CLAIMED} AS name"), _suppliers(spark, sf_dir).select("name"))


@query("T38")
def name_ratios(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_regionkey", F.lower("n_name").alias("name"))
    m = n.select("n_regionkey", F.col("name").alias("other"))
    pairs = n.join(m, "n_regionkey").filter("name < other")
    return pairs.select("name", "other", names.token_sort_ratio("name", "other").alias("ratio"), names.partial_ratio("name", "other").alias("partial"))


# Reviews -------------------------------------------------------------------------------------------------------------


def _times_sql(needle: str) -> str:
    return f"(length(low) - length(replace(low, {D.quoted(needle)}, ''))) / {len(needle)}"


def _matched_sql(needles, green: bool) -> str:
    if not green:
        return D.any_sql("low", needles)
    return "(" + " OR ".join(f"{_times_sql(n)} > {' + '.join(_times_sql(x + n) for x in R.NEGATIONS)}" for n in needles) + ")"


_LOW = f"(SELECT *, lower(text) AS low FROM {D.REVIEWS_SQL})"
_HITS = " UNION ALL ".join(f"SELECT doc_id, company, site, dated_at, text, low, '{code}' AS code, '{polarity}' AS polarity, {weight} AS weight, {i} AS place, list_min([{', '.join(f'nullif(strpos(low, {D.quoted(n)}), 0)' for n in needles)}]) AS pos FROM rv WHERE {_matched_sql(needles, polarity == 'green')}" for i, (code, polarity, weight, needles) in enumerate(R.PATTERNS))


@query("T19", f"WITH rv AS {_LOW}, hits AS ({_HITS}) SELECT doc_id, string_agg(code, ',' ORDER BY place) AS codes FROM hits GROUP BY 1")
def pattern_codes(spark, sf_dir):
    codes = F.array_join(R.pattern_codes(F.col("text")), ",")
    return D.reviews(spark, sf_dir).select("doc_id", F.explode(F.filter(F.array(codes), lambda c: c != "")).alias("codes"))  # as a filter, it would read each text twice


@query("A38", f"""
WITH rv AS {_LOW}, hits AS ({_HITS}), n AS (SELECT *, row_number() OVER (PARTITION BY company, code ORDER BY doc_id) AS r FROM hits)
SELECT company, code, polarity, weight::INT AS weight, count(*) AS hits, list(substr(text, greatest(pos - 20, 1)::BIGINT, 60) ORDER BY r) FILTER (r <= 3) AS quotes FROM n GROUP BY ALL""")
def patterns(spark, sf_dir):
    return R.pattern_summary(D.reviews(spark, sf_dir), "company", "doc_id", "text")


@query("L14", f"""
WITH rv AS {_LOW}, hits AS ({_HITS}) SELECT company, code, row_number() OVER (PARTITION BY company ORDER BY polarity <> 'red', -weight * count(*), code)::INT AS place FROM hits GROUP BY company, code, polarity, weight""")
def ordered_patterns(spark, sf_dir):
    from pyspark.sql import Window

    p = R.pattern_summary(D.reviews(spark, sf_dir), "company", "doc_id", "text")
    w = Window.partitionBy("company").orderBy(F.col("polarity") != "red", -F.col("weight") * F.col("hits"), "code")
    return p.select("company", "code", F.row_number().over(w).alias("place"))


def _section_sql(start: str, stop: str) -> str:
    return rf"trim(regexp_extract(regexp_extract(text, '(?is){start}:[\s;.,-]*(.*?)(?:{stop}:|\z)', 1), '^\s*([^\n]+)', 1))"


@query("T27", f"SELECT doc_id, {_section_sql('pros', 'cons')} AS pros, {_section_sql('cons', 'pros')} AS cons FROM {D.REVIEWS_SQL}")
def sections(spark, sf_dir):
    t = F.col("text")
    return D.reviews(spark, sf_dir).select("doc_id", R.section(t, "pros", "cons").alias("pros"), R.section(t, "cons", "pros").alias("cons"))


_PADDED = "' ' || trim(regexp_replace(lower({}), '[^0-9a-z]+', ' ', 'g'))"
_HEAD = "CASE WHEN doc_id % 4 = 0 THEN 'Senior Developer' WHEN doc_id % 4 = 1 THEN 'Shop manager' ELSE '' END"


def _area_score_sql(roles, marks) -> str:
    part = lambda w, x, k: f"{k} * contains({w}, ' {x}')::INT"
    return " + ".join([*(part("head", x, 3) for x in roles), *(part("body", x, 2) for x in roles), *(part("body", x, 1) for x in marks)])


_AREA_SQL = f"""
a0 AS (SELECT doc_id, {_PADDED.format('text')} AS body, {_PADDED.format(_HEAD)} AS head FROM {D.REVIEWS_SQL}),
a1 AS (SELECT doc_id, unnest([{', '.join(f"'{n}'" for n in R.AREAS)}]) AS a, unnest([{', '.join(_area_score_sql(*v) for v in R.AREAS.values())}]) AS s FROM a0),
a2 AS (SELECT *, row_number() OVER w AS r, lead(s) OVER w AS second FROM a1 WINDOW w AS (PARTITION BY doc_id ORDER BY s DESC, a)),
ar AS (SELECT doc_id, CASE WHEN s >= 2 AND s - second >= 1 THEN a ELSE 'unknown' END AS area, s AS score FROM a2 WHERE r = 1)"""


def _with_area(rows: DataFrame) -> DataFrame:
    code, score = R.area(F.col("text"), F.expr(_HEAD))
    return rows.withColumns({"area": code, "score": score})


@query("T29", f"WITH {_AREA_SQL} SELECT doc_id, area, score::INT AS score FROM ar")
def areas(spark, sf_dir):
    return _with_area(D.reviews(spark, sf_dir)).select("doc_id", "area", F.col("score").cast("int").alias("score"))


_GRADES = ["junior", "middle", "senior", "lead", "architect"]


@query("T39", f"SELECT doc_id, list_max([{', '.join(f'CASE WHEN contains(w, {chr(39)} {g} {chr(39)}) THEN {i} END' for i, g in enumerate(_GRADES))}])::INT AS grade FROM (SELECT doc_id, {_PADDED.format('text')} || ' ' AS w FROM {D.CLAIMS_SQL})")
def grades(spark, sf_dir):
    """The highest grade that a text asks for, by whole words; null without one."""
    w = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower("text"), "[^0-9a-z]+", " ")), F.lit(" "))
    rows = D.claims(spark, sf_dir).select("doc_id", w.alias("w"))
    return rows.select("doc_id", F.array_max(F.array(*(F.when(F.contains("w", F.lit(f" {g} ")), F.lit(i)) for i, g in enumerate(_GRADES)))).alias("grade"))


@query("T42", f"SELECT doc_id, contains(n, 'firm ' || (doc_id % 23)) OR contains(n, 'company') AS ours FROM (SELECT doc_id, {_PADDED.format('text')} AS n FROM {D.REVIEWS_SQL})")
def about_company(spark, sf_dir):
    """Whether a text speaks of its company: by name, or as a whole company."""
    n = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower("text"), "[^0-9a-z]+", " ")))
    rows = D.reviews(spark, sf_dir).select("doc_id", n.alias("n"), F.lower("company").alias("name"))
    return rows.select("doc_id", (F.contains("n", F.col("name")) | F.contains("n", F.lit("company"))).alias("ours"))


_MENTIONS = ["'At ' || company || ' all is well. '", "'Frm' || substr(company, 5) || ' pays. '", "'About F1rm ' || substr(company, 6) || '. '", "''"]


def mentioning(spark, sf_dir) -> DataFrame:
    """Reviews whose first words may name their company, some with a letter less or another one."""
    said = "CASE doc_id % 4 " + " ".join(f"WHEN {i} THEN {m}" for i, m in enumerate(_MENTIONS)) + " END"
    return D.reviews(spark, sf_dir).selectExpr("doc_id", "company", f"{said} || text AS text")


@query("T25")
def company_on_page(spark, sf_dir):
    """Whether a page names its company: whole, or in a part that is 80 or more alike, anywhere in it. tests hold it against brute force."""
    return mentioning(spark, sf_dir).select("doc_id", name_held(F.lower("company"), F.lower("text"), 80.0).alias("named"))


_BOILER = "bp AS (SELECT h FROM (SELECT DISTINCT sha1(text) AS h, company FROM " + D.REVIEWS_SQL + ") GROUP BY h HAVING count(*) >= 3)"


def _any(words) -> str:
    return D.any_sql("low", words)


_LEGIT = rf"""
{_BOILER},
l0 AS (SELECT *, {_any(R.WORK)} AS work, length(text) - length(replace(replace(text, '>', ''), '|', '')) AS marks, length(text) - length(translate(text, '.!?', '')) AS stops, sha1(text) IN (SELECT h FROM bp) AS boilerplate FROM {_LOW}),
l1 AS (SELECT doc_id, work AS work_words, {_any(R.FIRST)} AS first_person, pros <> '' AND cons <> '' AS pros_cons, rating IS NOT NULL AS has_rating, dated_at IS NOT NULL AS has_date,
  NOT work AS no_work_context, {_any(R.CUSTOMER)} AND NOT work AS customer, {_any(R.REPLY)} AS employer_reply, {_any(R.READER)} AS reader_address, regexp_matches(text, '{R.PROMO}') AS promo, marks > 5 AND stops < 3 AS navigation, boilerplate FROM l0),
lg AS (SELECT doc_id, round({' + '.join(f'{c}::INT * {w}' for c, w in R.PLUS.items())} - ({' + '.join(f'{c}::INT * {w}' for c, w in R.MINUS.items())}), 2) AS score,
  array_to_string(list_filter([{', '.join(f"CASE WHEN {c} THEN '{c}' END" for c in ('no_work_context', 'customer', 'employer_reply', 'reader_address', 'promo', 'navigation', 'boilerplate'))}], lambda c: c IS NOT NULL), ',') AS reasons, {' OR '.join(R.HARD)} AS hard FROM l1)"""


def judged(rows: DataFrame, **more: Column) -> DataFrame:
    """(doc_id, company, more, score, reasons, ok) of reviews; a text that three or more companies have is boilerplate.

    Texts are read once: what they tell is written, and only that is grouped and joined. more: further columns that are read from them.
    """
    signs = R.legitimacy_signs(*(F.col(c) for c in ("text", "rating", "dated_at", "pros", "cons")))
    each = written(rows.select("doc_id", "company", F.sha1(F.col("text").cast("binary")).alias("h"), signs.alias("signs"), *(c.alias(k) for k, c in more.items())))
    shared = each.select("h", "company").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n >= 3").select("h", F.lit(True).alias("boilerplate"))
    score, reasons, ok = R.legitimacy(F.col("signs"), F.coalesce("boilerplate", F.lit(False)))
    return each.join(shared, "h", "left").select("doc_id", "company", *more, score.alias("score"), reasons.alias("reasons"), ok.alias("ok"))


@query("T23", f"WITH {_LEGIT} SELECT doc_id, score, reasons, NOT hard AND score >= 1 AS ok FROM lg")
def legitimacy(spark, sf_dir):
    return judged(D.reviews(spark, sf_dir)).select("doc_id", "score", F.array_join("reasons", ",").alias("reasons"), "ok")


_TRUST = {"forum": 0.5, "web": 0.7}
_NORMAL = r"array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), ' ')"
_RED = [n for _, p, _, ns in R.PATTERNS if p == "red" for n in ns]
_GREEN = [n for _, p, _, ns in R.PATTERNS if p == "green" for n in ns]
_ON = ["no_specifics", "cliches", "empty_cons", "short_top", "rating_mismatch", "ad_tail", "impersonal", "low_trust_site", "ai_text", "dup_other_company", "dup_same_company", "burst", "uniform_length"]
_FAKE = rf"""
{_SIGNALS}, cd AS (SELECT doc_id, len(string_split({_CODES}, ',')) >= 3 AND {_CODES} <> '' AS ai FROM g2),
r0 AS (SELECT *, length(text) AS n, sha1({_NORMAL}) AS h, count(*) OVER (PARTITION BY company) AS total, min(site) OVER (PARTITION BY company) = max(site) OVER (PARTITION BY company) AS one_site FROM {_LOW}),
r1 AS (SELECT *, min(company) OVER (PARTITION BY h) <> max(company) OVER (PARTITION BY h) AS elsewhere, count(*) OVER (PARTITION BY company, h) > 1 AS twice FROM r0),
b0 AS (SELECT a.company, a.dated_at FROM r1 a JOIN r1 b ON a.company = b.company AND b.dated_at BETWEEN a.dated_at AND a.dated_at + 6 GROUP BY a.company, a.dated_at, a.doc_id HAVING count(*) >= 3),
bu AS (SELECT DISTINCT r1.doc_id FROM r1 JOIN b0 ON r1.company = b0.company AND r1.dated_at BETWEEN b0.dated_at AND b0.dated_at + 6),
e0 AS (SELECT a.company, a.n FROM r1 a JOIN r1 b ON a.company = b.company AND b.n <= a.n AND 10 * (a.n - b.n) <= a.n AND b.n >= 200 WHERE a.n >= 200 GROUP BY a.company, a.n, a.doc_id HAVING count(*) >= 3),
ev AS (SELECT DISTINCT r1.doc_id FROM r1 JOIN e0 ON r1.company = e0.company AND r1.n <= e0.n AND 10 * (e0.n - r1.n) <= e0.n AND r1.n >= 200),
s0 AS (SELECT r1.doc_id, company, total, NOT regexp_matches(text, '[0-9]') AND NOT {_any(R.WORK)} AS no_specifics, n <= 700 AND ({' + '.join(f"contains(low, '{c}')::INT" for c in R.CLICHES)}) >= 2 AS cliches,
  lower(trim(cons)) IN ('no', 'none', 'nothing') AS empty_cons, coalesce(rating >= 4.5 AND n < 200, false) AS short_top,
  coalesce((rating >= 4.5 AND {_any(_RED)}) OR (rating <= 2.0 AND NOT {_any(_RED)} AND {_any(_GREEN)}), false) AS rating_mismatch,
  regexp_matches(low, 'buy now|https?://') AS ad_tail, {_any(('plays a key role', 'wide range of opportunities'))} AS impersonal, one_site AND CASE site WHEN 'forum' THEN 0.5 WHEN 'web' THEN 0.7 ELSE 1.0 END < 0.8 AS low_trust_site,
  ai AS ai_text, elsewhere AS dup_other_company, NOT elsewhere AND twice AS dup_same_company, r1.doc_id IN (SELECT doc_id FROM bu) AS burst, r1.doc_id IN (SELECT doc_id FROM ev) AS uniform_length FROM r1 JOIN cd USING (doc_id)),
s1 AS (SELECT * REPLACE ({', '.join(f'{c} AND NOT (total >= 8 AND avg({c}::INT) OVER (PARTITION BY company) > 0.5) AS {c}' for c in ('uniform_length', 'dup_same_company', 'burst'))}) FROM s0),
fk AS (SELECT doc_id, company, array_to_string(list_filter([{', '.join(f"CASE WHEN {c} THEN '{c}' END" for c in _ON)}], lambda c: c IS NOT NULL), ',') AS signals, round(least(1.0, ({' + '.join(f'{c}::INT * {R.SIGNALS[c]}' for c in _ON)}) / 6.0), 2) AS sc, {' OR '.join(c for c in R.TEXT_SIGNALS if c in _ON)} AS own FROM s1),
fv AS (SELECT doc_id, company, signals, CASE WHEN sc >= 0.6 AND NOT own THEN 0.6 ELSE sc END AS fake_score, CASE WHEN sc >= 0.6 AND own THEN 'fake' WHEN sc >= 0.35 THEN 'suspect' ELSE 'clean' END AS label FROM fk)"""


def suspicious(rows: DataFrame) -> DataFrame:
    """(company, doc_id, signals, fake_score, label) of reviews."""
    known = signal_codes(rows.withColumn("h", T.text_hash(F.col("text"))))
    found = R.item_signals(known, _TRUST)
    score, label = R.fake_verdict(F.col("signals"))
    return found.select("company", "doc_id", F.array_join("signals", ",").alias("signals"), score.alias("fake_score"), label.alias("label"))


@query("T43", f"WITH {_FAKE} SELECT doc_id, signals, fake_score, label FROM fv")
def fake_signals(spark, sf_dir):
    return suspicious(D.reviews(spark, sf_dir)).select("doc_id", "signals", "fake_score", "label")


@query("Z24", f"WITH {_FAKE} SELECT doc_id, label, row_number() OVER (PARTITION BY company ORDER BY fake_score DESC, doc_id)::INT AS place FROM fv WHERE label <> 'clean'")
def most_suspicious(spark, sf_dir):
    from pyspark.sql import Window

    rows = suspicious(D.reviews(spark, sf_dir)).filter("label <> 'clean'")
    return rows.select("doc_id", "label", F.row_number().over(Window.partitionBy("company").orderBy(F.desc("fake_score"), "doc_id")).alias("place"))


_RISK = f"""
{_FAKE}, {_LEGIT.replace('WITH ', '')}, rv AS {_LOW}, hits AS ({_HITS}),
pa AS (SELECT company, bool_or(polarity = 'red' AND weight >= 4 AND n >= 2) AS heavy, bool_or(polarity = 'red' AND n >= 2) AS red, bool_or(polarity = 'green' AND n >= 2) AS green FROM (SELECT company, code, polarity, weight, count(*) AS n FROM hits GROUP BY ALL) GROUP BY 1),
co AS (SELECT fv.company, count(*) AS n, avg((label = 'fake')::INT) >= 0.3 AND count(*) >= 5 AS flagged, sum(CASE label WHEN 'clean' THEN 1.0 WHEN 'suspect' THEN 0.5 ELSE 0 END) AS clean_weight,
  round(avg((rating <= 2)::INT), 9) AS negative, round(sum(rating * CASE label WHEN 'clean' THEN 1.0 WHEN 'suspect' THEN 0.5 ELSE 0 END) / nullif(sum(CASE WHEN rating IS NOT NULL THEN CASE label WHEN 'clean' THEN 1.0 WHEN 'suspect' THEN 0.5 ELSE 0 END END), 0), 2) AS rating
  FROM fv JOIN rv USING (doc_id) GROUP BY 1),
rk AS (SELECT company, n, clean_weight, rating, CASE WHEN flagged THEN 'red' WHEN clean_weight < 3 THEN 'thin' WHEN coalesce(heavy, false) OR coalesce(negative, 0) >= 0.6 OR coalesce(rating <= 2.5, false) THEN 'red'
  WHEN coalesce(red, false) OR coalesce(negative, 0) >= 0.3 OR coalesce(rating < 3.8, false) THEN 'yellow' WHEN coalesce(green, false) OR coalesce(rating >= 4, false) THEN 'green' ELSE 'yellow' END AS risk FROM co LEFT JOIN pa USING (company))"""


def dossier(rows: DataFrame) -> DataFrame:
    """(company, n, clean_weight, rating, risk): bought reviews weigh nothing or half; confirmed patterns have two reviews or more."""
    label = suspicious(rows).select("doc_id", "label")
    weight = F.when(F.col("label") == "clean", 1.0).when(F.col("label") == "suspect", 0.5).otherwise(0.0)
    known = rows.join(label, "doc_id").withColumn("w", weight)
    per = known.groupBy("company").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("label") == "fake").cast("int")).alias("fake"),
        F.sum("w").alias("clean_weight"),
        F.round(F.coalesce(F.avg((F.col("rating") <= 2).cast("int")), F.lit(0.0)), 9).alias("negative"),
        F.round(F.try_divide(F.sum(F.col("rating") * F.col("w")), F.sum(F.when(F.col("rating").isNotNull(), F.col("w")))), 2).alias("rating"),
    )
    p = R.pattern_summary(rows, "company", "doc_id", "text").filter("hits >= 2")
    some = lambda x: F.max(x)
    light = p.groupBy("company").agg(some((F.col("polarity") == "red") & (F.col("weight") >= 4)).alias("heavy"), some(F.col("polarity") == "red").alias("red"), some(F.col("polarity") == "green").alias("green"))
    every = per.join(light, "company", "left")
    on = lambda c: F.coalesce(c, F.lit(False))
    level = R.risk(F.col("n"), (F.col("fake") >= 0.3) & (F.col("n") >= 5), F.col("clean_weight"), on("heavy"), on("red"), on("green"), F.col("negative"), F.col("rating"))
    return every.select("company", "n", "clean_weight", "rating", level.alias("risk"))


@query("T44", f"WITH {_RISK} SELECT company, risk FROM rk")
def risk_levels(spark, sf_dir):
    return dossier(D.reviews(spark, sf_dir)).select("company", "risk")


@query("C2", f"WITH {_RISK} SELECT * FROM rk")
def dossiers(spark, sf_dir):
    return dossier(D.reviews(spark, sf_dir))


@query("C3", f"""
WITH {_LEGIT}, {_AREA_SQL}, ok AS (SELECT r.doc_id, company, area, r.text FROM {_LOW} r JOIN lg USING (doc_id) JOIN ar USING (doc_id) WHERE NOT hard AND lg.score >= 1)
SELECT doc_id, company, area FROM (SELECT *, row_number() OVER (PARTITION BY company, sha1({_NORMAL}) ORDER BY doc_id) AS r FROM ok) WHERE r = 1""")
def assembled(spark, sf_dir):
    """Reviews that are legitimate, the first of equal ones of a company, with their area."""
    area, _ = R.area(F.col("text"), F.expr(_HEAD))
    rows = judged(D.reviews(spark, sf_dir), area=area, normal=T.text_hash(F.col("text"))).filter("ok")
    first = rows.groupBy("company", "normal").agg(F.min_by(F.struct("doc_id", "area"), "doc_id").alias("s"))
    return first.select("s.doc_id", "company", "s.area")
