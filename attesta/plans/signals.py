"""Queries of text signals: injected instructions, generated text and legitimacy of reviews (ids T of the operator inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions import text as T
from attesta.operators import generated as gen
from attesta.operators import injection as inj
from attesta.plans import derived as D
from attesta.plans.registry import query
from attesta.sources.tables import table

_TRIM = r"regexp_replace({}, '^[ \n\t\r]+|[ \n\t\r]+$', '', 'g')"
_VISIBLE = f"regexp_replace(t, '{inj.INVISIBLE}', '', 'g')"
_PLAIN = rf"regexp_replace(translate(lower({_VISIBLE}), '{inj.CYRILLIC}', '{inj.LATIN}'), '{inj.SEPARATORS}', ' ', 'g')"
_TIGHT = rf"regexp_replace(lower({_VISIBLE}), '[^\p{{L}}]', '', 'g')"
_TIGHT2 = rf"regexp_replace(translate(lower({_VISIBLE}), '{inj.CYRILLIC}', '{inj.LATIN}'), '[^\p{{L}}]', '', 'g')"


def _says_sql(phrases) -> str:
    tight = inj.glued(phrases)
    return f"({D.any_sql('low', phrases)} OR {D.any_sql('plain', inj.as_latin(phrases))} OR {D.any_sql('tight', tight)} OR {D.any_sql('tight2', inj.as_latin(tight))})"


def _findings_sql(source: str, key: str) -> str:
    """The findings of (key, text) rows: common table expressions that end with `found`."""
    return rf"""
src AS (SELECT {key}, text, {D.any_sql('lower(text)', inj.CONTEXT)} AS soft FROM {source}),
ln AS (SELECT {key}, soft, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS line FROM src),
rd AS MATERIALIZED (SELECT {key}, soft, t, line::INT AS line, lower(t) AS low, {_PLAIN} AS plain, {_TIGHT} AS tight, {_TIGHT2} AS tight2, regexp_matches(t, '{inj.INVISIBLE}') AS hidden FROM ln WHERE trim(t) <> ''),
sd AS MATERIALIZED (SELECT *, {_says_sql(inj.ADDRESS)} AS address, {_says_sql(inj.COMMANDS)} AS command, {_says_sql(inj.DANGEROUS)} AS danger FROM rd),
f0 AS (SELECT {key}, line, 'dangerous' AS code, 'red' AS level FROM sd WHERE danger
  UNION ALL SELECT {key}, line, 'assistant_address', CASE WHEN soft AND NOT command AND NOT hidden THEN 'yellow' ELSE 'red' END FROM sd WHERE address
  UNION ALL SELECT {key}, line, 'hidden_command', 'red' FROM sd WHERE command AND hidden
  UNION ALL SELECT {key}, line, 'command', 'yellow' FROM sd WHERE command AND NOT hidden AND NOT address
  UNION ALL SELECT {key}, line, 'markup', 'yellow' FROM sd WHERE regexp_matches(t, '{inj.MARKUP}')
  UNION ALL SELECT {key}, line, 'base64', 'yellow' FROM sd WHERE regexp_matches(t, '{inj.BASE64}')
  UNION ALL SELECT {key}, line, 'homoglyph', 'yellow' FROM sd WHERE len(list_filter(regexp_extract_all(lower(t), '{inj.MIXED}'), lambda w: length(w) > 3)) >= 2),
iv AS (SELECT {key} FROM sd GROUP BY {key} HAVING bool_or(hidden) AND NOT bool_or(command AND hidden)),
found AS (SELECT * FROM f0 UNION ALL SELECT {key}, -1, 'invisible', 'yellow' FROM iv)"""


@query("T10", rf"SELECT doc_id, {_PLAIN.replace('lower(regexp_replace(t,', 'lower(regexp_replace(text,')} AS plain FROM {D.ATTACKS_SQL}")
def undisguised(spark, sf_dir):
    return D.attacked(spark, sf_dir).select("doc_id", inj.undisguised(F.col("text")).alias("plain"))


@query("T11", f"SELECT doc_id, {_TIGHT} AS tight, {_TIGHT2} AS latin FROM (SELECT doc_id, text AS t FROM {D.ATTACKS_SQL})")
def squeezed(spark, sf_dir):
    a, b = inj.squeezed(F.col("text"))
    return D.attacked(spark, sf_dir).select("doc_id", a.alias("tight"), b.alias("latin"))


@query("T12", f"""
WITH {_findings_sql(D.ATTACKS_SQL, 'doc_id')}
SELECT src.doc_id, CASE WHEN bool_or(level = 'red') THEN 'red' WHEN count(code) > 0 THEN 'yellow' ELSE 'clean' END AS level, count(code) AS n, coalesce(array_to_string(list_sort(list(DISTINCT code) FILTER (code IS NOT NULL)), ','), '') AS codes
FROM src LEFT JOIN found USING (doc_id) GROUP BY src.doc_id""")
def injected(spark, sf_dir):
    rows = D.attacked(spark, sf_dir)
    return inj.report(rows, inj.findings(rows, "doc_id", "text"), "doc_id")


@query("T12_lines", f"WITH {_findings_sql(D.ATTACKS_SQL, 'doc_id')} SELECT doc_id, line, code, level FROM found")
def injected_lines(spark, sf_dir):
    return inj.findings(D.attacked(spark, sf_dir), "doc_id", "text")


@query("T13", rf"""
WITH b AS (SELECT doc_id, unnest(string_split(x, chr(10))) AS t, unnest(range(len(string_split(x, chr(10))))) AS line FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '{inj.INVISIBLE}', '', 'g'), '{inj.MARKUP.replace("(?i)", "(?im)")}', ' ', 'g') AS x FROM {D.ATTACKS_SQL})),
r AS (SELECT doc_id, t, line, lower(t) AS low, {_PLAIN} AS plain, {_TIGHT} AS tight, {_TIGHT2} AS tight2 FROM b),
k AS (SELECT doc_id, string_agg(t, chr(10) ORDER BY line) FILTER (NOT ({_says_sql(inj.ADDRESS)} OR {_says_sql(inj.COMMANDS)} OR {_says_sql(inj.DANGEROUS)})) AS kept FROM r GROUP BY doc_id)
SELECT doc_id, {_TRIM.format(r"regexp_replace(coalesce(kept, ''), '\n{3,}', chr(10) || chr(10), 'g')")} AS text FROM k""")
def cleaned(spark, sf_dir):
    return D.attacked(spark, sf_dir).select("doc_id", inj.cleaned(F.col("text")).alias("text"))


def _hidden_sql(expr: str) -> str:
    one = rf"""regexp_extract_all({expr}, '(?is)<{{tag}}\b[^>]*(?:{inj.HIDING.replace("'", "''")})[^>]*>(.*?)</{{tag}}\s*>', 1)"""
    every = "list_concat(" + ", ".join(one.replace("{tag}", t) for t in ("div", "span", "p")) + ")"
    return rf"list_sort(list_filter(list_transform({every}, lambda b: trim(regexp_replace(regexp_replace(b, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))), lambda b: length(b) >= 20))"


@query("T9", f"SELECT page_id, {_hidden_sql('html')} AS hidden FROM {D.PAGES_SQL}")
def hidden_blocks(spark, sf_dir):
    return D.pages(spark, sf_dir).select("page_id", F.array_sort(inj.hidden_blocks(F.col("html"))).alias("hidden"))


@query("T14", rf"""
WITH pg AS (SELECT page_id, html, regexp_replace(html, '<[^>]+>', ' ', 'g') AS text FROM {D.PAGES_SQL}), {_findings_sql('pg', 'page_id')},
every AS (SELECT page_id, code, level FROM found UNION ALL SELECT page_id, 'hidden_html', 'red' FROM (SELECT page_id, unnest({_hidden_sql('html')}) AS b FROM pg))
SELECT pg.page_id, CASE WHEN bool_or(level = 'red') THEN 'red' WHEN count(code) > 0 THEN 'yellow' ELSE 'clean' END AS level, count(code) AS n, coalesce(array_to_string(list_sort(list(DISTINCT code) FILTER (code IS NOT NULL)), ','), '') AS codes
FROM pg LEFT JOIN every USING (page_id) GROUP BY pg.page_id""")
def page_scan(spark, sf_dir):
    rows = D.pages(spark, sf_dir)
    return inj.report(rows, inj.html_findings(rows, "page_id", "html"), "page_id")


# Generated text ------------------------------------------------------------------------------------------------------

_CV = "CASE WHEN len({0}) > 0 AND list_avg({0}) > 0 THEN round(list_stddev_pop({0}) / list_avg({0}), 9) ELSE 0 END"
_TOP = "coalesce(list_max(map_values(list_histogram({0}))), 0)"
_COUNT = "len(regexp_extract_all({}, '{}'))"
_SIGNALS = rf"""
g0 AS (SELECT doc_id, dated_at, text, lower(text) AS low, greatest(length(text) / 1000.0, 0.001) AS per,
  list_filter(list_transform(regexp_extract_all(text, '[^.!?\n]+'), lambda s: trim(s)), lambda s: length(s) >= 2) AS se,
  list_filter(list_transform(regexp_extract_all(text, '(?m)^\s*(?:[-*•]|[0-9]+[.)])\s+(.+)$', 1), lambda s: trim(s)), lambda s: length(s) >= 1) AS bu FROM {D.REVIEWS_SQL}),
g1 AS (SELECT *, list_transform(se, lambda s: length(s)::DOUBLE) AS sl, list_transform(bu, lambda s: length(s)::DOUBLE) AS bl,
  list_filter(list_transform(se, lambda s: lower(regexp_extract(s, '[A-Za-z0-9]+'))), lambda w: w <> '') AS op,
  list_transform(bu, lambda b: regexp_extract(lower(regexp_extract(b, '[A-Za-z0-9]+')), '(ing|ed|ion|ness|ment|ly|s)$', 1)) AS bk FROM g0),
g2 AS (SELECT doc_id, dated_at, text,
  {_COUNT.format('text', gen.SPECIFIC)} / per < 1.0 AS no_specifics,
  ({' + '.join(f"contains(low, {D.quoted(m)})::INT" for m in gen.MARKERS)}) / per >= 2.0 AS markers,
  len(bu) >= 4 AND {_CV.format('bl')} <= 0.15 AND {_TOP.format('bk')} / len(bu)::DOUBLE >= 0.8 AS uniform_bullets,
  len(se) >= 4 AND {_CV.format('sl')} < 0.25 AS even_sentences,
  len(se) >= 4 AND {_TOP.format('op')} >= 3 AS same_openings,
  {_COUNT.format('text', gen.TRIAD)} >= 2 AS triads,
  NOT ({D.any_sql('low', gen.HUMAN)} OR regexp_matches(text, '\.{{3,}}|!{{2,}}|\?{{2,}}|\b[A-Z]{{4,}}\b')) AS too_clean,
  {_COUNT.format('text', '[—–]')} / per >= 4.0 AS dashes FROM g1)"""
_CODES = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{c}' END" for c in gen.WEIGHTS) + "], lambda c: c IS NOT NULL), ',')"


def signal_codes(rows):
    """rows with `codes`, those of the signals of generated text."""
    held = rows.select("*", *(c.alias(k) for k, c in gen.parts(F.col("text")).items()))
    return held.select(*rows.columns, gen.codes(gen.signals(F.col("text"))).alias("codes"))


@query("T15", f"WITH {_SIGNALS} SELECT doc_id, {_CODES} AS codes FROM g2")
def ai_signals(spark, sf_dir):
    return signal_codes(D.reviews(spark, sf_dir)).select("doc_id", F.array_join("codes", ",").alias("codes"))


@query("T16", f"""
WITH {_SIGNALS}, s AS (SELECT doc_id, length(trim(text)) < {gen.LEAST_CHARS} OR dated_at < DATE '{gen.FIRST_DAY}' AS skip, round(least(1.0, ({' + '.join(f"{c}::INT * {w}" for c, w in gen.WEIGHTS.items())}) / {gen.CAP}), 2) AS sc FROM g2)
SELECT doc_id, CASE WHEN skip THEN 0.0 ELSE sc END AS score, CASE WHEN skip THEN 'skip' WHEN sc >= {gen.HIGH} THEN 'likely' WHEN sc >= {gen.LOW} THEN 'suspect' ELSE 'human' END AS label FROM s""")
def ai_verdict(spark, sf_dir):
    rows = signal_codes(D.reviews(spark, sf_dir))
    score, label = gen.verdict(F.col("codes"), F.col("text"), F.col("dated_at"))
    return rows.select("doc_id", score.alias("score"), label.alias("label"))


_FEATURES = rf"""
h0 AS (SELECT doc_id, trim(text) AS body, lower(trim(text)) AS low, list_filter(list_transform(string_split_regex(trim(text), '[.!?…]+'), lambda s: trim(s)), lambda s: length(s) >= 1) AS pa, regexp_extract_all(lower(trim(text)), '[a-z]+') AS w FROM {D.REVIEWS_SQL}),
h1 AS (SELECT *, list_transform(pa, lambda s: len(regexp_extract_all(s, '[A-Za-z]+'))::DOUBLE) AS sz FROM h0),
h2 AS (SELECT *, list_filter(sz, lambda n: n > 0) AS ct FROM h1),
h3 AS (SELECT doc_id, length(body) >= 120 AS long,
  ({' + '.join(f"contains(low, {D.quoted(m)})::INT" for m in gen.MARKERS)}) >= 2 AS filler, NOT {D.any_sql('low', gen.COLLOQUIAL)} AS no_colloquial,
  NOT regexp_matches(body, '[0-9]') AS no_number, NOT regexp_matches(body, '[a-z,] [A-Z][a-z]{{2,}}') AS no_name,
  len(ct) >= 3 AND {_CV.format('ct')} <= 0.25 AS even, len(pa) >= 4 AND coalesce(list_min(sz), 9) >= 6 AS no_short,
  ({' + '.join(f"contains(low, '{m}')::INT" for m in gen.PROS_CONS)}) >= 2 AS pros_cons, contains(body, '—') AS typography,
  len(w) >= 60 AND len(list_distinct(w)) / len(w)::DOUBLE >= 0.75 AS no_repeats FROM h2),
h AS (SELECT doc_id, {', '.join(f"(long AND {c})::INT AS {c}" for c in gen.FEATURES)} FROM h3)"""


@query("T17", f"WITH {_FEATURES} SELECT * FROM h")
def ai_features(spark, sf_dir):
    rows = D.reviews(spark, sf_dir).select("doc_id", *(c.alias(k) for k, c in gen.feature_parts(F.col("text")).items()))
    return rows.select("doc_id", *(c.alias(k) for k, c in gen.features().items()))


@query("T17_variety", r"SELECT doc_id, round(CASE WHEN len(w) > 0 THEN len(list_distinct(w)) / len(w)::DOUBLE ELSE 0 END, 6) AS variety FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents)")
def variety(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(gen.type_token_ratio(F.col("text")), 6).alias("variety"))


@query("T8", r"SELECT page_id, trim(regexp_replace(replace(replace(replace(lower(regexp_replace(html, '<[^>]+>', ' ', 'g')), '&nbsp;', ' '), '&amp;', '&'), 'ё', 'е'), '\s+', ' ', 'g')) AS text FROM pages")
def record_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.plain_record(F.col("html")).alias("text"))


@query("T4", r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w)
SELECT a.doc_id, round(CASE WHEN len(a.s) = 0 OR len(b.s) = 0 THEN 0 ELSE len(list_intersect(a.s, b.s)) / least(len(a.s), len(b.s))::DOUBLE END, 6) AS similarity FROM s a JOIN s b ON b.doc_id = a.doc_id + 1""")
def containment(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", T.shingle_hashes(T.words(F.col("text"))).alias("s"))
    after = rows.select((F.col("doc_id") - 1).alias("doc_id"), F.col("s").alias("t"))
    return rows.join(after, "doc_id").select("doc_id", F.round(T.containment(F.col("s"), F.col("t")), 6).alias("similarity"))
