"""The library's registered queries: name to callable, and name to equivalent SQL.

They run the operators over the whole driver tables: events play the figures
that reports publish again, orders make statements, documents are texts.
Expressions that both engines read alike are written once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexicon import Lexicon
from ..functions.numbers import py_round, py_round_sql
from ..functions.slots import with_slots
from ..functions.text import lexicon_ratio, prefix_hits, reading_ease, sentences, syllables, words
from ..operators import blocks, facts, features, linkage, matching, rules, scoring, tables
from ..operators.common import once

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- figures: the sum of a day's values of a type, as each of three reports has it

_K = "CAST(regexp_extract(props, '[0-9]+', 0) AS INT)"
_FIGURE = ("'c' || CAST(user_id % 5 AS STRING)", "2000 + day(ts)", "event_type", f"2020 + {_K} % 3")
_TARGET = ("'c' || CAST(user_id % 5 AS STRING)", "2000 + day(ts)", "'target_' || event_type", f"CASE {_K} % 3 WHEN 0 THEN 2005 WHEN 1 THEN 2015 ELSE 2025 END")


def _figures(spark: SparkSession, sf_dir: str, parts: tuple[str, ...] = _FIGURE) -> DataFrame:
    company, year, metric, pub = parts
    e = _table(spark, sf_dir, "events").selectExpr(f"{company} AS company", f"{year} AS year", f"{metric} AS metric", f"{pub} AS pub", "floor(value * 100) AS cents", f"{_K} AS k")
    e = e.groupBy("company", "year", "metric", "pub").agg((F.sum("cents") / F.lit(100e0)).alias("value"), F.max("k").alias("page"))
    return e.withColumns({"unit": F.lit("u"), "scope": F.lit(None).cast("string"), "source": F.format_string("%s/%d_report.csv", "company", "pub"), "ord": F.col("pub").cast("long")})


def _figures_sql(parts: tuple[str, ...] = _FIGURE) -> str:
    company, year, metric, pub = parts
    return f"""fig AS (
  SELECT company, year, metric, pub, sum(cents) / 100e0 AS value, max(k) AS page, company || '/' || CAST(pub AS STRING) || '_report.csv' AS source FROM (
    SELECT {company} AS company, {year} AS year, {metric} AS metric, {pub} AS pub, floor(value * 100) AS cents, {_K} AS k FROM events
  ) GROUP BY company, year, metric, pub
), steps AS (
  SELECT *, lag(value) OVER c AS before, lag(source) OVER c AS before_source FROM fig WINDOW c AS (PARTITION BY company, year, metric ORDER BY pub)
), changes AS (
  SELECT *, CASE WHEN before <> 0 THEN (value - before) / abs(before) * 100 END AS pct FROM steps WHERE before IS NOT NULL AND before <> value
)"""


_RESTATED = f"{_figures_sql()}, restated AS (SELECT *, {py_round_sql('pct', 2)} AS magnitude_pct FROM changes WHERE pct IS NULL OR abs(pct) >= 0.5)"


@query(f"WITH {_RESTATED} SELECT company, year, metric AS canonical_metric, magnitude_pct, before_source AS old_source, source AS new_source, page FROM restated")
def restatements(spark, sf_dir):
    return facts.restatements(_figures(spark, sf_dir)).select("company", "year", "canonical_metric", "magnitude_pct", "old_source", "new_source", "page")


@query(f"WITH {_figures_sql()} SELECT company, count(*) FILTER (WHERE n >= 2) AS comparable_pairs FROM (SELECT company, year, metric, count(DISTINCT pub) AS n FROM fig GROUP BY company, year, metric) GROUP BY company")
def comparable_pairs(spark, sf_dir):
    return facts.comparable_pairs(_figures(spark, sf_dir))


_SCORE = "0.45e0 * (restated / pairs * 100e0) + 0.40e0 * (least(coalesce(m, 0e0) / 30e0, 1e0) * 100e0) + 0.15e0 * least(0 * 25e0, 100e0)"


@query(f"""WITH {_RESTATED}, n AS (
  SELECT company, CAST(count(*) FILTER (WHERE n >= 2) AS DOUBLE) AS pairs FROM (SELECT company, year, metric, count(DISTINCT pub) AS n FROM fig GROUP BY company, year, metric) GROUP BY company
), e AS (SELECT company, CAST(count(*) AS DOUBLE) AS restated, median(abs(magnitude_pct)) AS m, max(abs(magnitude_pct)) AS most FROM restated GROUP BY company),
s AS (SELECT company, pairs, restated, m, most, least(({_SCORE}) * 0.65e0 / 0.65e0, 100e0) AS x FROM n JOIN e USING (company))
SELECT company, CAST(pairs AS BIGINT) AS comparable_pairs, CAST(restated AS BIGINT) AS restated, {py_round_sql('m', 2)} AS median_pct, {py_round_sql('most', 2)} AS max_pct, {py_round_sql('x', 1)} AS goalpost_drift FROM s""")
def drift_score(spark, sf_dir):
    return facts.drift_by_company(_figures(spark, sf_dir)).select("company", "comparable_pairs", "restated", "median_pct", "max_pct", "goalpost_drift")


_NAMES = f"'all' AS company, 2000 + day(ts) AS pub, event_type || '_' || CAST({_K} AS STRING) AS metric, event_id AS ord"


@query(f"""WITH names AS (SELECT DISTINCT pub, metric, regexp_replace(metric, '_[^_]*$', '') AS prefix FROM (SELECT {_NAMES} FROM events)),
pubs AS (SELECT pub, lead(pub) OVER (ORDER BY pub) AS next FROM (SELECT DISTINCT pub FROM names)),
dropped AS (SELECT n.pub, p.next, n.metric, n.prefix FROM names n JOIN pubs p ON n.pub = p.pub WHERE p.next IS NOT NULL AND NOT EXISTS (SELECT 1 FROM names x WHERE x.pub = p.next AND x.metric = n.metric)),
added AS (SELECT p.pub, n.metric, n.prefix FROM names n JOIN pubs p ON n.pub = p.next WHERE NOT EXISTS (SELECT 1 FROM names x WHERE x.pub = p.pub AND x.metric = n.metric))
SELECT d.next AS year, d.metric AS old, a.metric AS new FROM dropped d JOIN added a ON d.pub = a.pub AND d.prefix = a.prefix""")
def redefinitions(spark, sf_dir):
    names = _table(spark, sf_dir, "events").selectExpr(*_split(_NAMES)).withColumns({"year": F.col("pub"), "source": F.format_string("d/%d_report.csv", "pub")})
    return facts.redefinitions(names).select("year", "old", "new")


_LAST = "last AS (SELECT company, year, metric, max(pub) AS last_pub, min(pub) AS first_pub FROM fig GROUP BY company, year, metric), newest AS (SELECT company, max(pub) AS newest FROM fig GROUP BY company)"


@query(f"""WITH {_figures_sql(_TARGET)}, {_LAST}
SELECT company, year, 'target_value_changed' AS type, metric AS canonical_metric, {py_round_sql('pct', 2)} AS magnitude_pct, value < before AS weakened, before_source AS old_source, source AS new_source FROM changes
UNION ALL SELECT l.company, l.year, 'commitment_dropped', l.metric, -100e0, true, l.company || '/' || CAST(l.last_pub AS STRING) || '_report.csv', l.company || '/' || CAST(n.newest AS STRING) || '_report.csv'
FROM last l JOIN newest n ON l.company = n.company WHERE l.last_pub < n.newest AND l.year > l.last_pub""")
def target_drift(spark, sf_dir):
    return facts.target_drift(_figures(spark, sf_dir, _TARGET)).select("company", "year", "type", "canonical_metric", "magnitude_pct", "weakened", "old_source", "new_source")


@query(f"""WITH {_figures_sql(_TARGET)}, {_LAST} SELECT l.company, count(*) FILTER (WHERE l.first_pub < l.last_pub OR (l.last_pub < n.newest AND l.year > l.last_pub)) AS comparable_targets
FROM last l JOIN newest n ON l.company = n.company GROUP BY l.company""")
def comparable_targets(spark, sf_dir):
    return facts.comparable_targets(_figures(spark, sf_dir, _TARGET))


@query(f"WITH {_figures_sql()} SELECT company, metric, year, pub, value FROM (SELECT *, max(pub) OVER (PARTITION BY company, metric) AS newest FROM fig) WHERE pub = newest")
def latest_series(spark, sf_dir):
    return facts.latest_series(_figures(spark, sf_dir)).select("company", "metric", "year", "pub", "value")


@query(f"WITH {_figures_sql()} SELECT company, metric, year, max(pub) AS pub, arg_max(value, pub) AS value FROM fig GROUP BY company, metric, year")
def latest_by_metric_year(spark, sf_dir):
    return facts.latest_by_year(_figures(spark, sf_dir)).select("company", "metric", "year", "pub", "value")


_MOVED = "least(coalesce(sum(CAST(round(abs(magnitude_pct) * 100) AS BIGINT)) FILTER (WHERE {w}), 0) / 100e0 / 60e0, 1e0) * 100e0"


@query(f"""WITH {_RESTATED}, y AS (SELECT DISTINCT company, year FROM fig), e AS (
  SELECT company, year, count(*) AS n, sum(abs(magnitude_pct)) AS s, count(*) FILTER (WHERE pub <= year + 18) AS known, sum(abs(magnitude_pct)) FILTER (WHERE pub <= year + 18) AS t FROM restated GROUP BY company, year)
SELECT y.company, y.year, CASE WHEN known > 0 THEN round(least(t / 60e0, 1e0) * 100e0, 0) END AS score_as_of, CASE WHEN n > 0 THEN round(least(s / 60e0, 1e0) * 100e0, 0) END AS score_hindsight
FROM y LEFT JOIN e ON y.company = e.company AND y.year = e.year""")
def asof_intensity(spark, sf_dir):
    figures = _figures(spark, sf_dir)
    # data years are moved on by 18, so that some reports come after them and some before
    events = facts.restatements(figures).withColumn("year", F.col("year") + 18)
    out = facts.exact_intensity(events, figures.withColumn("year", F.col("year") + 18)).withColumn("year", F.col("year") - 18)
    return out.withColumns({c: F.round(c, 0) for c in ("score_as_of", "score_hindsight")})


_WORSE = "SELECT o_orderpriority AS company, year(o_orderdate) AS year, sum(floor(o_totalprice * 100)) AS value FROM orders WHERE month(o_orderdate) <= 6 GROUP BY o_orderpriority, year(o_orderdate)"


@query(f"WITH t AS ({_WORSE}) SELECT a.company, a.year FROM t a JOIN t b ON a.company = b.company AND a.year = b.year + 1 WHERE a.value > b.value")
def worsening_years(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").where("month(o_orderdate) <= 6").groupBy(F.col("o_orderpriority").alias("company"), F.year("o_orderdate").alias("year"))
    trend = o.agg(F.sum(F.floor(F.col("o_totalprice") * 100)).alias("value")).withColumns({"metric": F.lit("total_emissions"), "source": F.lit("x"), "ord": F.lit(0)})
    return facts.worsening_years(facts.emissions_trend(trend))


_YEARS = tuple(range(1995, 2002))


@query("SELECT o_orderpriority AS metric, " + ", ".join(f"CASE count(DISTINCT CASE WHEN year(o_orderdate) = {y} THEN o_orderstatus END) WHEN 0 THEN '-' WHEN 1 THEN 'OK' ELSE 'CONFLICT' END AS \"{y}\"" for y in _YEARS) + " FROM orders GROUP BY o_orderpriority")
def coverage_matrix(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("metric"), F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("value"))
    return facts.coverage_matrix(o, list(_YEARS))


@query("SELECT l_orderkey AS source, l_linenumber AS page, count(*) AS n FROM lineitem d WHERE NOT EXISTS (SELECT 1 FROM lineitem v WHERE v.l_returnflag = 'R' AND v.l_orderkey = d.l_orderkey AND v.l_linenumber = d.l_linenumber) GROUP BY l_orderkey, l_linenumber")
def anti_verified(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_linenumber").alias("page"), "l_returnflag")
    return facts.unverified(rows, rows.where("l_returnflag = 'R'")).groupBy("source", "page").agg(F.count("*").alias("n"))


@query(f"""WITH t AS (SELECT s_suppkey, s_nationkey, CASE WHEN s_acctbal >= 0 THEN s_acctbal END AS score FROM supplier),
p AS (SELECT *, count(*) OVER w AS n, percent_rank() OVER (PARTITION BY s_nationkey, score IS NOT NULL ORDER BY score) * 100 AS r FROM t WINDOW w AS (PARTITION BY s_nationkey, score IS NOT NULL))
SELECT s_suppkey, CASE WHEN score IS NOT NULL AND n > 1 THEN {py_round_sql('r', 1)} END AS peer_percentile FROM p""")
def peer_percentile(spark, sf_dir):
    s = _table(spark, sf_dir, "supplier").withColumn("score", F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal")))
    return scoring.with_percentile(s, "score", ("s_nationkey",)).select("s_suppkey", "peer_percentile")


# ---- texts

_SPLIT = "list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \\t\\n\\x0b\\f\\r]+([A-Z0-9])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"


@query(f"SELECT doc_id, len(s) AS n_sentences, md5(array_to_string(s, chr(1))) AS digest FROM (SELECT doc_id, {_SPLIT} AS s FROM documents)")
def sentence_split(spark, sf_dir):
    s = _table(spark, sf_dir, "documents").withColumn("s", sentences(F.col("text")))
    return s.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.md5(F.array_join("s", "\u0001")).alias("digest"))


#: Terms that the documents' invented words hold.
_TERMS, _MORE = ("the", "of", "and"), ("tion", "ea", "la", "de")
_HITS = lambda terms: " + ".join(f"len(regexp_extract_all(low, '(?:^|[^\\p{{L}}\\p{{N}}_]){t}'))" for t in terms)


@query(f"""WITH t AS (SELECT doc_id, lower(text) AS low, len(regexp_extract_all(text, '[A-Za-z][A-Za-z''-]*')) AS n FROM documents),
h AS (SELECT doc_id, n, {_HITS(_TERMS)} AS a, {_HITS(_MORE)} AS b FROM t), r AS (SELECT *, CAST(a AS DOUBLE) / n AS x, CAST(b AS DOUBLE) / n AS y FROM h)
SELECT doc_id, n AS n_words, b AS hits, CASE WHEN n > 0 THEN {py_round_sql('x', 4)} ELSE 0e0 END AS vague_ratio, CASE WHEN n > 0 THEN {py_round_sql('y', 4)} ELSE 0e0 END AS hedging_ratio FROM r""")
def lexicon_features(spark, sf_dir):
    low = F.lower("text")
    d = _table(spark, sf_dir, "documents").withColumn("n", F.size(words(F.col("text"))))
    return d.select("doc_id", F.col("n").cast("long").alias("n_words"), prefix_hits(low, _MORE).cast("long").alias("hits"), lexicon_ratio(low, _TERMS, F.col("n")).alias("vague_ratio"), lexicon_ratio(low, _MORE, F.col("n")).alias("hedging_ratio"))


@query(f"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z''-]*')) AS word FROM documents),
s AS (SELECT doc_id, count(*) AS n, sum(greatest(1, len(regexp_extract_all(rtrim(lower(word), 'e'), '[aeiouy]+')))) AS syl FROM w GROUP BY doc_id),
x AS (SELECT d.doc_id, coalesce(CAST(s.syl AS BIGINT), 0) AS syllables, CASE WHEN coalesce(s.n, 0) >= 3 THEN 206.835e0 - 1.015e0 * (s.n / CAST(greatest(1, len(regexp_extract_all(d.text, '[.!?]'))) AS DOUBLE)) - 84.6e0 * (CAST(s.syl AS DOUBLE) / s.n) END AS r FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id)
SELECT doc_id, syllables, {py_round_sql('r', 1)} AS readability FROM x""")
def readability(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    total = F.aggregate(words(F.col("text")), F.lit(0), lambda a, w: a + syllables(w))
    return d.select("doc_id", total.cast("long").alias("syllables"), reading_ease(F.col("text")).alias("readability"))


@query("""WITH b AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
p AS (SELECT source, count(DISTINCT doc_id) AS n FROM documents GROUP BY source),
r AS (SELECT b.source, lower(b.line) AS low FROM b GROUP BY b.source, lower(b.line) HAVING count(DISTINCT b.doc_id) >= (SELECT greatest(2, floor(p.n * 0.05e0)) FROM p WHERE p.source = b.source))
SELECT b.doc_id, count(*) AS kept FROM b WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.source = b.source AND r.low = lower(b.line)) GROUP BY b.doc_id""")
def boilerplate(spark, sf_dir):
    lines = _table(spark, sf_dir, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n", -1)).alias("ord", "text"), F.lit(10.0).alias("size"), F.lit(False).alias("bold"))
    return blocks.without_boilerplate(lines, 0.05).groupBy(F.col("page").alias("doc_id")).agg(F.count("*").alias("kept"))


_HEADED = "CASE turn % 4 WHEN 0 THEN role || ' part' WHEN 2 THEN 'more of ' || role ELSE 'Said in turn ' || CAST(turn AS STRING) || '.' END"


@query(f"""WITH b AS (SELECT conv_id, turn, {_HEADED} AS text, CASE turn % 4 WHEN 0 THEN 1 WHEN 2 THEN 2 END AS level FROM conversations),
g AS (SELECT *, sum(CASE WHEN level = 1 THEN 1 ELSE 0 END) OVER o AS part, last_value(CASE WHEN level = 1 THEN text END IGNORE NULLS) OVER o AS h1 FROM b WINDOW o AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)),
h AS (SELECT *, last_value(CASE WHEN level = 2 THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id, part ORDER BY turn ROWS UNBOUNDED PRECEDING) AS h2 FROM g)
SELECT conv_id, turn, concat_ws(' > ', h1, h2) AS section_path FROM h WHERE level IS NULL""")
def section_path(spark, sf_dir):
    b = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.lit(1).alias("page"), F.col("turn").alias("ord"), F.expr(_HEADED).alias("text"), F.expr("CASE turn % 4 WHEN 0 THEN 30e0 ELSE 10e0 END").alias("size"), F.expr("turn % 4 = 2").alias("bold"))
    # a page of body text, so that its median size is that of the body
    body = b.select("doc", "page").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(60)))).select("doc", "page", (-1 - F.col("k")).cast("long").alias("ord"), F.lit("Filler.").alias("text"), F.lit(10.0).alias("size"), F.lit(False).alias("bold"))
    out = blocks.with_sections(b.unionByName(body)).where("level is null and ord >= 0")
    return out.select(F.col("doc").alias("conv_id"), F.col("ord").alias("turn"), "section_path")


# ---- statements made of orders

_MADE = "o_orderkey % 5 <> 0"
_STATEMENT = (
    "'We ' || CASE o_orderkey % 4 WHEN 0 THEN 'will' WHEN 1 THEN 'should' WHEN 2 THEN 'have' ELSE 'shall' END || CASE WHEN o_orderkey % 7 = 0 THEN ' not' ELSE '' END || ' cut scope ' || CAST(o_orderkey % 3 + 1 AS STRING) || ' emissions'"
    f" || CASE WHEN {_MADE} THEN ' by ' || CAST(o_orderkey % 60 + 4 AS STRING) || '%' ELSE '' END || ' by ' || CAST(2025 + o_orderkey % 10 AS STRING) || ' against a ' || CAST(2010 + o_orderkey % 8 AS STRING) || ' base year' || CASE WHEN o_orderkey % 11 = 0 THEN ' if rules allow' ELSE '' END || '.'"
)


def _statements(spark: SparkSession, sf_dir: str, work=lambda t: with_slots(t, Lexicon())) -> DataFrame:
    """Statements with their slots; each different sentence is read once."""
    s = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("company"), F.year("o_orderdate").alias("publish_year"), F.expr(_STATEMENT).alias("sentence"))
    return once(s, "sentence", work).withColumn("ord", F.col("id"))


_SLOTS = f"""st AS (SELECT o_orderkey AS id, o_orderpriority AS company, year(o_orderdate) AS publish_year, {_STATEMENT} AS sentence,
  CASE WHEN {_MADE} THEN CAST(o_orderkey % 60 + 4 AS STRING) || '%' ELSE '' END AS quantity, CAST(2010 + o_orderkey % 8 AS STRING) AS baseline, CAST(2025 + o_orderkey % 10 AS STRING) AS deadline,
  'Scope ' || CAST(o_orderkey % 3 + 1 AS STRING) AS scope, CASE o_orderkey % 4 WHEN 1 THEN 'hedged' WHEN 2 THEN 'achievement' ELSE 'firm' END AS strength, o_orderkey % 7 = 0 AS negated, o_orderkey % 11 = 0 AS conditional,
  'target' AS claim_type, CASE WHEN {_MADE} THEN 1e0 ELSE 0.75e0 END AS slot_fill_score FROM orders)"""


@query(f"WITH {_SLOTS} SELECT id, quantity, baseline, deadline, scope, strength, negated, conditional, claim_type, slot_fill_score FROM st")
def slots(spark, sf_dir):
    return _statements(spark, sf_dir).select("id", "quantity", "baseline", "deadline", "scope", "strength", "negated", "conditional", "claim_type", "slot_fill_score")


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _statements(spark, sf_dir, lambda t: features.with_features(with_slots(t, Lexicon())))


_PART = "CAST({c} AS DOUBLE) / count(*)"


@query(f"""WITH {_SLOTS}, a AS (SELECT company, publish_year, count(*) AS n_claims, CAST(count(*) FILTER (WHERE quantity <> '') AS DOUBLE) / count(*) AS q, CAST(count(*) FILTER (WHERE negated) AS DOUBLE) / count(*) AS n,
  CAST(count(*) FILTER (WHERE conditional) AS DOUBLE) / count(*) AS c, CAST(count(*) FILTER (WHERE strength = 'firm' AND NOT negated) AS DOUBLE) / count(*) AS f, CAST(count(*) FILTER (WHERE strength = 'hedged' AND NOT negated) AS DOUBLE) / count(*) AS h,
  CASE WHEN count(*) FILTER (WHERE strength = 'hedged' AND NOT negated) > 0 THEN CAST(count(*) FILTER (WHERE strength = 'firm' AND NOT negated) AS DOUBLE) / count(*) FILTER (WHERE strength = 'hedged' AND NOT negated) END AS r,
  sum(CASE WHEN quantity <> '' THEN 800 ELSE 600 END) / 1000e0 / count(*) AS s FROM st GROUP BY company, publish_year)
SELECT company, publish_year, n_claims, {py_round_sql('s', 4)} AS mean_specificity, {py_round_sql('q', 3)} AS quantified_share, {py_round_sql('n', 3)} AS negated_share, {py_round_sql('c', 3)} AS conditional_share, {py_round_sql('f', 3)} AS firm_share, {py_round_sql('h', 3)} AS hedged_share, {py_round_sql('r', 2)} AS commitment_ratio FROM a""")
def year_language(spark, sf_dir):
    return features.year_series(_features(spark, sf_dir)).select("company", "publish_year", "n_claims", "mean_specificity", "quantified_share", "negated_share", "conditional_share", "firm_share", "hedged_share", "commitment_ratio")


@query(f"WITH {_SLOTS}, g AS (SELECT claim_type, strength, count(*) AS n, avg(CASE WHEN quantity <> '' THEN 1 ELSE 0 END) AS q FROM st GROUP BY claim_type, strength) SELECT claim_type, strength, n, {py_round_sql('q', 3)} AS quantity_rate FROM g")
def breakdown(spark, sf_dir):
    return features.breakdown(_statements(spark, sf_dir)).select("claim_type", "strength", "n", "quantity_rate")


_WORSE_ALL = "w AS (SELECT a.company, a.year FROM t a JOIN t b ON a.company = b.company AND a.year = b.year + 1 WHERE a.value > b.value)"


@query(f"""WITH {_SLOTS}, t AS ({_WORSE}), {_WORSE_ALL}
SELECT company, 'no_proof' AS sin, count(*) AS n FROM st WHERE quantity <> '' GROUP BY company
UNION ALL SELECT st.company, 'hidden_trade_off', count(*) FROM st JOIN w ON st.company = w.company AND st.publish_year = w.year WHERE quantity <> '' AND NOT negated GROUP BY st.company""")
def rule_tags(spark, sf_dir):
    return rules.sin_counts(rules.tagged(_features(spark, sf_dir), worsening_years(spark, sf_dir)))


@query(f"""WITH {_SLOTS}, t AS ({_WORSE}), {_WORSE_ALL}, g AS (SELECT st.company, CASE WHEN quantity <> '' THEN 70 ELSE 0 END AS s FROM st), r AS (SELECT company, count(*) AS n_claims, count(*) FILTER (WHERE s > 0) AS n_tagged, sum(s) / 100e0 / count(*) * 100 AS x FROM g GROUP BY company)
SELECT company, n_claims, n_tagged, {py_round_sql('x', 1)} AS sins_severity FROM r""")
def sin_scores(spark, sf_dir):
    f = _features(spark, sf_dir)
    return rules.sin_scores(f, rules.tagged(f, worsening_years(spark, sf_dir)))


@query(f"""WITH {_SLOTS}, r AS (SELECT company, id, row_number() OVER (PARTITION BY company ORDER BY CASE WHEN quantity <> '' THEN 0.8 ELSE 0.6 END DESC, id) AS rank FROM st) SELECT company, id, rank FROM r WHERE rank <= 220""")
def top_claims(spark, sf_dir):
    return scoring.top_claims(_features(spark, sf_dir)).select("company", "id", "rank")


_LINKS = (
    "CASE c_custkey % 2 WHEN 0 THEN 'renewable_share' ELSE 'scope_1' END AS family, CAST(c_custkey % 90 + 5 AS DOUBLE) AS target, c_custkey % 13 <> 0 AS is_percent,"
    " 2012 + CAST(c_custkey % 8 AS INT) AS baseline, 2018 + CAST(c_custkey % 12 AS INT) AS deadline, 2022 AS as_of"
)
_AT = "CAST((c_custkey * 7 + {y} * 3) % 50 + 10 AS DOUBLE)"
_BASE = "greatest(baseline, 2015)"
_WAY = f"CASE WHEN deadline > {_BASE} THEN least(1e0, greatest(0e0, CAST(2022 - {_BASE} AS DOUBLE) / (deadline - {_BASE}))) ELSE 1e0 END"
_START = _AT.format(y=f"{_BASE}")


@query(f"""WITH l AS (SELECT c_custkey, {_LINKS} FROM customer), e AS (SELECT *, {_WAY} AS elapsed, {_START} AS start, {_AT.format(y=2022)} AS actual FROM l WHERE is_percent),
r AS (SELECT *, CASE WHEN family = 'renewable_share' THEN start + (target - start) * elapsed ELSE start * (1 - target / 100 * elapsed) END AS required FROM e)
SELECT c_custkey, family, CASE WHEN family = 'renewable_share' THEN CASE WHEN actual >= required AND NOT (deadline <= 2022 AND actual < target) THEN 'on_track' ELSE 'behind' END ELSE CASE WHEN actual <= required THEN 'on_track' ELSE 'behind' END END AS status,
  {py_round_sql('required', 3)} AS required, {py_round_sql('elapsed', 3)} AS elapsed FROM r""")
def glidepath(spark, sf_dir):
    series = F.array(*(F.struct(F.lit(y).alias("year"), F.expr(_AT.format(y=y)).alias("value"), F.lit("t").alias("unit")) for y in range(2015, 2023)))
    links = _table(spark, sf_dir, "customer").selectExpr("c_custkey", *_split(_LINKS)).withColumn("series", series)
    return linkage.glidepath(links).where("status is not null").select("c_custkey", "family", "status", "required", "elapsed")


def _split(columns: str) -> list[str]:
    """A list of columns at commas outside brackets."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(columns):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(columns[last:i])
            last = i + 1
    return [*out, columns[last:]]


_SUBS = (
    "CASE WHEN toxic = 0 THEN CAST(doc_id % 101 AS DOUBLE) END AS vagueness, CASE WHEN quality = 1 THEN CAST(doc_id % 97 AS DOUBLE) END AS unsupported_claims,"
    " CASE WHEN doc_id % 3 > 0 THEN CAST(doc_id % 89 AS DOUBLE) END AS sins_severity, CASE WHEN doc_id % 5 > 1 THEN CAST(doc_id % 83 AS DOUBLE) END AS goalpost_drift"
)
_WEIGHTED = tuple(scoring.Settings().weights.items())


@query(f"""WITH s AS (SELECT doc_id, {_SUBS} FROM labels), b AS (SELECT *, {' + '.join(f'CAST({n} IS NOT NULL AS INT)' for n, _ in _WEIGHTED)} AS n_measured,
  ({' + '.join(f'coalesce({n} * {w}::DOUBLE, 0)' for n, w in _WEIGHTED)}) / nullif({' + '.join(f'CASE WHEN {n} IS NULL THEN 0e0 ELSE {w}::DOUBLE END' for n, w in _WEIGHTED)}, 0) AS x FROM s)
SELECT doc_id, n_measured, CASE WHEN n_measured >= 3 THEN {py_round_sql('x', 1)} END AS overall, CASE WHEN n_measured >= 4 AND doc_id % 8 >= 5 THEN 'high' WHEN n_measured >= 3 AND doc_id % 8 >= 2 THEN 'medium' ELSE 'low' END AS confidence FROM b""")
def blend_abstain(spark, sf_dir):
    s = scoring.blended(_table(spark, sf_dir, "labels").selectExpr("doc_id", *_split(_SUBS)))
    return s.select("doc_id", "n_measured", "overall", scoring.confidence(F.col("n_measured"), F.col("doc_id") % 8).alias("confidence"))


@query(f"""WITH {_RESTATED}, a AS (SELECT company, pub AS report_year, count(*) AS x FROM restated GROUP BY company, pub),
l AS (SELECT 'c' || CAST(s_suppkey % 5 AS STRING) AS company, 2019 + s_suppkey % 4 AS report_year, count(*) FILTER (WHERE s_acctbal > 0) AS y FROM supplier GROUP BY 1, 2 HAVING count(*) FILTER (WHERE s_acctbal > 0) > 0)
SELECT coalesce(a.company, l.company) AS company, coalesce(a.report_year, l.report_year) AS report_year, coalesce(x, 0) AS numeric_restatements, coalesce(y, 0) AS language_softenings, coalesce(x, 0) > 0 AND coalesce(y, 0) > 0 AS both
FROM a FULL OUTER JOIN l ON a.company = l.company AND a.report_year = l.report_year""")
def cross_signal(spark, sf_dir):
    numeric = facts.restatements(_figures(spark, sf_dir)).withColumn("report_year", facts.publish_year(F.col("new_source")))
    language = _table(spark, sf_dir, "supplier").select(F.expr("'c' || CAST(s_suppkey % 5 AS STRING)").alias("company"), (F.lit(2019) + F.col("s_suppkey") % 4).alias("to_year"), F.when(F.col("s_acctbal") > 0, "scope_narrowed").otherwise("boilerplate_recycled").alias("type"))
    return scoring.cross_signal(numeric, language)


# ---- matching

_NAMED = "SELECT p_brand, CASE WHEN p_partkey % 2 = 0 THEN 'a' ELSE 'b' END AS side, p_partkey AS id, p_name AS text FROM part"


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").selectExpr("p_brand", "CASE WHEN p_partkey % 2 = 0 THEN 'a' ELSE 'b' END AS side", "p_partkey AS id", "p_name AS text")


_PAIRS = f"""t AS ({_NAMED}), ws AS (SELECT p_brand, side, id, ' ' || unnest(string_split(text, ' ')) || ' ' AS pad FROM t),
g AS (SELECT p_brand, side, id, unnest(list_concat(list_transform(range(1, greatest(1, len(pad) - 3) + 1), lambda i: substr(pad, i, 4)), CASE WHEN len(pad) > 4 THEN list_transform(range(1, greatest(1, len(pad) - 4) + 1), lambda i: substr(pad, i, 5)) ELSE [] END)) AS gram FROM ws),
tf AS (SELECT p_brand, side, id, gram, count(*) AS tf FROM g GROUP BY ALL), df AS (SELECT p_brand, gram, count(*) AS df FROM tf GROUP BY ALL), n AS (SELECT p_brand, count(*) AS n FROM t GROUP BY ALL),
x AS (SELECT tf.p_brand, side, id, tf.gram, tf * (ln((1e0 + n) / (1e0 + df)) + 1) AS w FROM tf JOIN df ON tf.p_brand = df.p_brand AND tf.gram = df.gram JOIN n ON tf.p_brand = n.p_brand),
u AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY p_brand, side, id)) AS v FROM x),
s AS (SELECT a.p_brand, a.id AS i, b.id AS j, sum(a.v * b.v) AS s FROM u a JOIN u b ON a.p_brand = b.p_brand AND a.gram = b.gram AND a.side = 'a' AND b.side = 'b' GROUP BY ALL),
pairs AS (SELECT p_brand, i, j, round(s, 4) AS similarity FROM s WHERE s >= 0.55)"""


@query(f"WITH {_PAIRS} SELECT p_brand, i, j, similarity FROM pairs")
def similar_pairs(spark, sf_dir):
    return matching.similarities(_names(spark, sf_dir), ["p_brand"]).withColumn("similarity", F.round("similarity", 4))


def _greedy_sql(pairs: str, keys: str) -> str:
    """CTEs in_turn, walk and taken: pairs (keys, i, j, rank) looked at one after another, in order of rank; each id of either side is taken once."""
    of = ", ".join(f"p.{k.strip()}" for k in keys.split(","))
    same = " AND ".join(f"p.{k.strip()} = w.{k.strip()}" for k in keys.split(","))
    free = "NOT list_contains(w.is_, p.i) AND NOT list_contains(w.js, p.j)"
    return f"""in_turn AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY rank DESC, i, j) AS n FROM {pairs}),
walk AS (SELECT DISTINCT {keys}, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS is_, CAST([] AS BIGINT[]) AS js, CAST(NULL AS BIGINT) AS i, CAST(NULL AS BIGINT) AS j, false AS free FROM in_turn
  UNION ALL SELECT {of}, p.n, CASE WHEN {free} THEN list_append(w.is_, p.i) ELSE w.is_ END, CASE WHEN {free} THEN list_append(w.js, p.j) ELSE w.js END, p.i, p.j, {free} FROM walk w JOIN in_turn p ON {same} AND p.n = w.n + 1),
taken AS (SELECT p.* FROM in_turn p JOIN walk w ON {same} AND p.n = w.n WHERE w.free)"""


@query(f"WITH RECURSIVE {_PAIRS}, ranked AS (SELECT p_brand, i, j, similarity AS rank FROM pairs), {_greedy_sql('ranked', 'p_brand')} SELECT p_brand, i, j, rank FROM taken")
def greedy_match(spark, sf_dir):
    return matching.matched_pairs(_names(spark, sf_dir), ["p_brand"], digits=4).drop("similarity")


def _small_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement of each supplier, in a report of its nation."""
    made = _STATEMENT.replace("o_orderkey", "s_suppkey")
    s = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.expr("'n' || CAST(s_nationkey AS STRING)").alias("company"), (2020 + F.col("s_suppkey") % 3).cast("int").alias("publish_year"), F.expr(made).alias("sentence"))
    return once(s, "sentence", lambda t: features.with_features(with_slots(t, Lexicon()))).withColumn("ord", F.col("id"))


_SMALL = _SLOTS.replace("o_orderpriority", "'n' || CAST(s_nationkey AS STRING)").replace("year(o_orderdate)", "2020 + s_suppkey % 3").replace("FROM orders", "FROM supplier").replace("o_orderkey", "s_suppkey")
_SAME = "lower(replace(o.scope, ' ', '_')) = lower(replace(n.scope, ' ', '_'))"  # the family follows from the scope


@query(f"""WITH RECURSIVE {_SMALL}, years AS (SELECT DISTINCT company, publish_year FROM st), steps AS (SELECT company, publish_year, lead(publish_year) OVER (PARTITION BY company ORDER BY publish_year) AS next FROM years),
t AS (SELECT s.company, s.publish_year, s.next, 'a' AS side, st.id, lower(st.sentence) AS text FROM steps s JOIN st ON s.company = st.company AND s.publish_year = st.publish_year WHERE next IS NOT NULL
  UNION ALL SELECT s.company, s.publish_year, s.next, 'b', st.id, lower(st.sentence) FROM steps s JOIN st ON s.company = st.company AND s.next = st.publish_year),
ws AS (SELECT company, publish_year, side, id, ' ' || unnest(string_split(text, ' ')) || ' ' AS pad FROM t),
g AS (SELECT company, publish_year, side, id, unnest(list_concat(list_transform(range(1, greatest(1, len(pad) - 3) + 1), lambda i: substr(pad, i, 4)), CASE WHEN len(pad) > 4 THEN list_transform(range(1, greatest(1, len(pad) - 4) + 1), lambda i: substr(pad, i, 5)) ELSE [] END)) AS gram FROM ws),
tf AS (SELECT company, publish_year, side, id, gram, count(*) AS tf FROM g GROUP BY ALL), df AS (SELECT company, publish_year, gram, count(*) AS df FROM tf GROUP BY ALL), c AS (SELECT company, publish_year, count(*) AS n FROM t GROUP BY ALL),
x AS (SELECT tf.*, tf * (ln((1e0 + n) / (1e0 + df)) + 1) AS w FROM tf JOIN df USING (company, publish_year, gram) JOIN c USING (company, publish_year)),
u AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY company, publish_year, side, id)) AS v FROM x),
dots AS (SELECT a.company, a.publish_year, a.id AS i, b.id AS j, sum(a.v * b.v) AS s FROM u a JOIN u b ON a.company = b.company AND a.publish_year = b.publish_year AND a.gram = b.gram AND a.side = 'a' AND b.side = 'b' GROUP BY ALL),
p AS (SELECT s.company, s.publish_year, s.next, o.id AS i, n.id AS j, CASE WHEN d.s >= 0.55 THEN round(d.s, 9) END AS sim,
  round(CASE WHEN {_SAME} THEN 0.6 ELSE 0 END + CASE WHEN o.deadline = n.deadline THEN 0.2 WHEN abs(CAST(o.deadline AS INT) - CAST(n.deadline AS INT)) = 1 THEN 0.1 ELSE 0 END + 0.2, 3) AS slot,
  concat_ws('; ', CASE WHEN {_SAME} THEN 'metric_family=' || lower(replace(o.scope, ' ', '_')) || '; scope=' || o.scope END, CASE WHEN o.deadline = n.deadline THEN 'deadline=' || o.deadline WHEN abs(CAST(o.deadline AS INT) - CAST(n.deadline AS INT)) = 1 THEN 'deadline~' || o.deadline || '/' || n.deadline END, 'claim_type=target') AS agreed
  FROM steps s JOIN st o ON s.company = o.company AND s.publish_year = o.publish_year JOIN st n ON s.company = n.company AND s.next = n.publish_year LEFT JOIN dots d ON d.company = s.company AND d.publish_year = s.publish_year AND d.i = o.id AND d.j = n.id),
ranked AS (SELECT *, CAST(greatest(coalesce(sim, 0e0), CASE WHEN slot >= 0.6 THEN slot ELSE 0 END) AS DOUBLE) AS rank FROM p WHERE sim IS NOT NULL OR slot >= 0.6), {_greedy_sql('ranked', 'company, publish_year')},
m AS (SELECT t.company, t.publish_year AS from_year, t.next AS to_year, coalesce({py_round_sql('sim', 3)}, 0e0) AS text, CAST(slot AS DOUBLE) AS slot, agreed, i, j, o.strength AS os, n.strength AS ns, o.negated AS was_no, n.negated AS is_no, o.quantity AS oq, n.quantity AS nq, o.deadline AS od, n.deadline AS nd FROM taken t JOIN st o ON t.i = o.id JOIN st n ON t.j = n.id),
e AS (SELECT *, 'boilerplate_recycled' AS type, 'near-identical wording republished; no change in commitment or evidence' AS detail FROM m WHERE text >= 0.93
  UNION ALL SELECT *, 'commitment_negated', 'commitment now negated: previously ''' || os || ''', now ''' || ns || ''' but negated' FROM m WHERE NOT was_no AND is_no AND os IN ('firm', 'hedged') AND ns IN ('firm', 'hedged')
  UNION ALL SELECT *, 'commitment_softened', 'commitment strength ''firm'' -> ''hedged''' FROM m WHERE NOT was_no AND NOT is_no AND os = 'firm' AND ns = 'hedged'
  UNION ALL SELECT *, 'achievement_reverted_to_aspiration', 'previously reported as achieved, now framed as an aim' FROM m WHERE NOT was_no AND NOT is_no AND os = 'achievement' AND ns = 'hedged'
  UNION ALL SELECT *, 'quantity_dropped', 'quantity ''' || oq || ''' no longer stated' FROM m WHERE oq <> '' AND nq = ''
  UNION ALL SELECT *, 'deadline_pushed', 'target year moved ' || od || ' -> ' || nd FROM m WHERE CAST(nd AS INT) > CAST(od AS INT)
  UNION ALL SELECT *, 'specificity_fell', 'specificity 0.80 -> 0.60 (-0.20)' FROM m WHERE oq <> '' AND nq = '')
SELECT company, type, detail, CAST(from_year AS INT) AS from_year, CAST(to_year AS INT) AS to_year, text AS tfidf_similarity, slot AS slot_similarity, CASE WHEN text >= 0.55 AND slot >= 0.6 THEN 'both' WHEN text >= 0.55 THEN 'text' ELSE 'slots' END AS matched_via, agreed AS matched_slots, i, j FROM e""")
def pair_diff(spark, sf_dir):
    return matching.language_drift(_small_claims(spark, sf_dir)).drop("old", "new").withColumn("matched_slots", F.array_join("matched_slots", "; "))


_PLACE = "SELECT id, CAST(instr(sentence, {c}) - 1 AS INT) AS begins, CAST(instr(sentence, {c}) - 1 + length({c}) AS INT) AS ends, '{kind}' AS kind, {c} AS term FROM st WHERE {c} <> ''"


@query(f"WITH {_SMALL} " + " UNION ALL ".join(_PLACE.format(c=c, kind=kind) for c, kind in (("quantity", "qty"), ("baseline", "baseline"), ("deadline", "deadline"))))
def highlights(spark, sf_dir):
    h = features.with_highlights(_small_claims(spark, sf_dir), Lexicon()).select("id", F.inline("highlights"))
    return h.withColumnsRenamed({"start": "begins", "end": "ends"})


@query(f"""WITH {_SMALL}, l AS (SELECT company, 100e0 - 2e0 * (CAST(baseline AS INT) - 2010) AS start, CAST(s.id % 60 + 4 AS DOUBLE) AS target, least(1e0, (2022 - CAST(baseline AS INT)) / CAST(CAST(deadline AS INT) - CAST(baseline AS INT) AS DOUBLE)) AS elapsed
  FROM st s WHERE quantity <> '' AND NOT negated AND NOT conditional),
a AS (SELECT company, count(*) AS n, count(*) FILTER (WHERE 76e0 > start * (1 - target / 100 * elapsed)) AS b FROM l GROUP BY company),
r AS (SELECT c.company, coalesce(n, 0) AS n_measurable, coalesce(b, 0) AS n_behind, CASE WHEN n >= 3 THEN 100e0 * b / n END AS x FROM (SELECT DISTINCT company FROM st) c LEFT JOIN a ON c.company = a.company)
SELECT company, n_measurable, n_behind, {py_round_sql('x', 1)} AS say_do_gap FROM r""")
def say_do(spark, sf_dir):
    years = F.explode(F.sequence(F.lit(2010), F.lit(2022)))
    metrics = F.explode(F.array(*(F.lit(f"scope_{i}_emissions") for i in (1, 2, 3))))
    f = _small_claims(spark, sf_dir).select("company").distinct().withColumn("year", years).select("company", "year", metrics.alias("metric"))
    f = f.withColumns({"value": (F.lit(100.0) - (F.col("year") - 2010) * 2), "unit": F.lit("t"), "source": F.lit("x/2023_report.csv"), "ord": F.col("year").cast("long")})
    links = linkage.say_do_links(_small_claims(spark, sf_dir), f)  # the series falls by two points a year
    return linkage.say_do_score(links, f)


@query("""WITH q AS (SELECT l_orderkey AS doc, list(CAST(trunc(l_quantity) AS INT) ORDER BY l_linenumber, l_quantity) AS v FROM lineitem GROUP BY l_orderkey),
t AS (SELECT doc, 1 AS row, 'Scope 1' AS metric, v[1:3] AS v FROM q UNION ALL SELECT doc, 2, 'Scope 2 market-based', v[1:4] FROM q)
SELECT doc, row, metric, 'ok' AS status, CAST(NULL AS VARCHAR) AS reason, CAST(2022 - k AS INT) AS year, CAST(v[k + 1] AS VARCHAR) AS value, 'tCO2e' AS unit,
  CASE WHEN k = 0 AND len(v) = 4 THEN CASE WHEN abs((v[1] - v[2]) / CAST(v[2] AS DOUBLE) * 100 - v[4]) > greatest(0.5e0, 0.1e0 * v[4]) THEN 'fail' ELSE 'pass' END ELSE 'not_available' END AS consistency_check, 'low' AS confidence
FROM t, (SELECT unnest([0, 1, 2]) AS k) WHERE len(v) >= 3
UNION ALL SELECT doc, row, metric, 'rejected', 'fewer values than years', NULL, NULL, NULL, 'not_available', NULL FROM t WHERE len(v) < 3""")
def figure_drafts(spark, sf_dir):
    """Tables laid out of line items: a header of years, then a label and its values."""
    pages = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))).alias("q"))
    rows = F.array(
        F.split(F.lit("Emissions (tCO₂e) 2022 2021 2020"), " "),
        F.concat(F.array(F.lit("Scope"), F.lit("1")), F.transform(F.slice("q", 1, 3), lambda x: x["l_quantity"].cast("int").cast("string"))),
        F.concat(F.split(F.lit("Scope 2 market-based"), " "), F.transform(F.slice("q", 1, 4), lambda x: x["l_quantity"].cast("int").cast("string"))),
    )
    words_ = pages.select("doc", F.lit(1).alias("page"), F.posexplode(rows).alias("r", "w")).select("doc", "page", "r", F.posexplode("w").alias("k", "text"))
    words_ = words_.select("doc", "page", (F.col("k") * 30.0).alias("x0"), (F.col("k") * 30.0 + 20).alias("x1"), (F.col("r") * 10.0).alias("top"), "text")
    return tables.draft(tables.word_rows(words_)).select("doc", "row", "metric", "status", "reason", "year", "value", "unit", "consistency_check", "confidence")


@query()
def nested_documents(spark, sf_dir):
    figures = _figures(spark, sf_dir)
    return scoring.documents(figures, drift_events=facts.drift_events(figures).select("company", "drift_id", "year", "type", "canonical_metric", "old", "new", "magnitude_pct"), series=facts.latest_series(figures).select("company", "metric", "year", "value"), scores=facts.drift_by_company(figures))


@query(f"""WITH raw AS (SELECT {_FIGURE[0]} AS company, {_FIGURE[1]} AS year, {_FIGURE[2]} AS metric, {_FIGURE[3]} AS pub, value, event_id FROM events),
last AS (SELECT company, year, metric, pub, arg_max(value, event_id) AS value FROM raw GROUP BY company, year, metric, pub),
s AS (SELECT *, lag(value) OVER c AS old, lag(pub) OVER c AS old_pub FROM last WINDOW c AS (PARTITION BY company, year, metric ORDER BY pub)),
p AS (SELECT *, CASE WHEN old <> 0 THEN (value - old) / abs(old) * 100 END AS pct FROM s WHERE old IS NOT NULL AND old <> value)
SELECT company, year, metric, old, value AS new, round(pct, 6) AS pct, old_pub, pub AS new_pub FROM p WHERE pct IS NULL OR abs(pct) >= 0.5""")
def streamed_revisions(spark, sf_dir):
    """Figures read as a stream, in micro-batches of what is there, into Parquet."""
    import uuid

    from ..operators.common import shared_dir
    from ..streaming.revisions import revisions

    source = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(source).schema
    company, year, metric, pub = _FIGURE
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(source if _is_folder(spark, source) else sf_dir + "/event[s].parquet")
    stream = stream.selectExpr(f"{company} AS company", f"{year} AS year", f"{metric} AS metric", "value", f"{pub} AS pub", "event_id AS ord")
    top = f"{shared_dir(spark)}/tidemark/revisions-{uuid.uuid4().hex}"
    out = revisions(stream)
    q = out.writeStream.format("parquet").option("path", f"{top}/rows").option("checkpointLocation", f"{top}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{top}/rows").withColumn("pct", F.round("pct", 6))


def _is_folder(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()
