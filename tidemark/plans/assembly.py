"""Registered queries for claims, their features and the assembled document.

Orders stand for claims, with columns made from their keys, so that every
branch of an operator occurs; the equivalent SQL states each branch outright.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexicon import Lexicon, Settings
from ..functions.numbers import py_round_sql
from ..functions.slots import deadline_or_leading, with_slots
from ..functions.text import join_lines, slug, squeeze, without_footnote_mark
from ..operators import blocks, facts, features, linkage, matching, scoring, tables
from ..sources import figures as sources
from .queries import _RESTATED, _figures, _figures_sql, _split, _table, query

# ---- claims made of orders; both engines read these alike

_K = "o_orderkey"
_CLAIM = {
    "company": "o_orderpriority", "publish_year": "year(o_orderdate)", "ord": _K, "id": _K, "sentence": "'s' || CAST(o_custkey % 400 AS STRING)",
    "claim_type": f"CASE {_K} % 5 WHEN 0 THEN 'target' WHEN 1 THEN 'achievement' WHEN 2 THEN 'attribute' WHEN 3 THEN 'other' ELSE 'target' END",
    "quantity": f"CASE {_K} % 4 WHEN 0 THEN '' WHEN 1 THEN '12%' WHEN 2 THEN '1,250 tonnes' ELSE '40' END",
    "baseline": f"CASE {_K} % 3 WHEN 0 THEN '2015' WHEN 1 THEN '' ELSE 'FY19' END", "deadline": f"CASE {_K} % 2 WHEN 0 THEN '2030' ELSE '' END",
    "scope": f"CASE {_K} % 3 WHEN 0 THEN 'Scope 1' WHEN 1 THEN '' END", "page": f"CASE WHEN {_K} % 7 > 0 THEN CAST({_K} % 7 AS STRING) END",
    "source_file": "'a/b/' || CAST(year(o_orderdate) AS STRING) || '_report.pdf'", "specificity_score": f"CASE WHEN {_K} % 6 > 0 THEN CAST({_K} % 97 AS DOUBLE) / 100e0 END",
    "max_severity": f"CASE WHEN {_K} % 11 > 0 THEN CAST({_K} % 10 AS DOUBLE) / 10e0 END",
    "verification_present": f"{_K} % 8 = 0", "quantification_present": f"{_K} % 4 > 0", "negated": f"{_K} % 9 = 0", "conditional": f"{_K} % 10 = 0",
}
_CLAIM_SQL = f"c AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _CLAIM.items())} FROM orders)"


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").selectExpr(*(f"{e} AS {n}" for n, e in _CLAIM.items()))


# ---- the contract's rows

_TAGGED = f"{_K} % 9 = 0"
_SINS = f"'sin' || CAST({_K} % 3 AS STRING)"
_LINKED = f"{_K} % 13 = 0"
_LINK = (f"CASE WHEN {_K} % 2 = 0 THEN 'on_track' ELSE 'behind' END", f"'family' || CAST({_K} % 4 AS STRING)", f"'metric' || CAST({_K} % 5 AS STRING)")


@query(f"""WITH {_CLAIM_SQL}, k AS (SELECT *, max(claim_type <> 'other') OVER (PARTITION BY company) AS any_kind FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY specificity_score DESC NULLS LAST, ord) AS rank FROM k WHERE claim_type <> 'other' OR NOT any_kind),
s AS (SELECT o_orderpriority AS company, 's' || CAST(o_custkey % 400 AS STRING) AS sentence, string_agg({_SINS}, ',' ORDER BY {_K}) AS sins FROM orders WHERE {_TAGGED} GROUP BY 1, 2),
l AS (SELECT o_orderpriority AS company, 's' || CAST(o_custkey % 400 AS STRING) AS sentence, arg_max({_LINK[0]}, {_K}) AS status, arg_max({_LINK[1]}, {_K}) AS family, arg_max({_LINK[2]}, {_K}) AS metric FROM orders WHERE {_LINKED} GROUP BY 1, 2)
SELECT r.company, r.company || '-claim-' || lpad(CAST(rank - 1 AS STRING), 4, '0') AS claim_id, r.sentence AS claim_text,
  CASE claim_type WHEN 'target' THEN 'target' WHEN 'achievement' THEN 'achievement' WHEN 'attribute' THEN 'product_label' ELSE 'general' END AS claim_type, l.family AS metric, l.metric AS canonical_metric,
  CASE quantity WHEN '12%' THEN 12e0 WHEN '1,250 tonnes' THEN 1250e0 WHEN '40' THEN 40e0 END AS target_value, CASE WHEN baseline = '2015' THEN 2015 END AS baseline_year, CASE WHEN deadline = '2030' THEN 2030 END AS target_year,
  nullif(scope, '') AS scope, verification_present AS has_third_party_verification, CAST(publish_year AS STRING) || '_report.pdf#p' || coalesce(page, 'None') AS chunk_id, CAST(publish_year AS STRING) || '_report.pdf' AS doc_name,
  publish_year, CAST(page AS INT) AS page, coalesce(s.sins, '') AS sins, l.status AS progress_status, r.specificity_score AS specificity
FROM r LEFT JOIN s ON r.company = s.company AND r.sentence = s.sentence LEFT JOIN l ON r.company = l.company AND r.sentence = l.sentence WHERE rank <= 220""")
def contract_claims(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    tagged = o.where(_TAGGED).selectExpr("o_orderpriority AS company", f"{_CLAIM['sentence']} AS sentence", f"{_K} AS ord", f"array(named_struct('sin', {_SINS}, 'severity', 0.5e0)) AS sins")
    links = o.where(_LINKED).selectExpr("o_orderpriority AS company", f"{_CLAIM['sentence']} AS sentence", f"{_K} AS ord", f"{_LINK[0]} AS status", f"{_LINK[1]} AS family", f"{_LINK[2]} AS metric")
    out = scoring.contract_claims(scoring.with_sins_and_links(scoring.top_claims(_claims(spark, sf_dir)), tagged, links))
    plain = ["company", "claim_id", "claim_text", "claim_type", "metric", "canonical_metric", "target_value", "baseline_year", "target_year", "scope", "has_third_party_verification", "chunk_id", "doc_name", "publish_year", "page"]
    return out.select(*plain, F.array_join("sins.sin", ",").alias("sins"), "progress_status", F.col("features.specificity_score").alias("specificity"))


_KINDS = "['commitment_softened', 'achievement_reverted_to_aspiration', 'commitment_negated', 'deadline_dropped', 'deadline_pushed', 'quantity_dropped', 'scope_narrowed', 'specificity_fell', 'boilerplate_recycled']"
_EVENT_SQL = f"e AS (SELECT o_orderpriority AS company, {_K} AS ord, {_KINDS}[(o_custkey % 9) + 1] AS type, year(o_orderdate) AS from_year, {_K} AS i, o_custkey AS j, CAST(o_totalprice AS BIGINT) AS detail FROM orders)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, matching.PRIORITY))
    o = _table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderpriority").alias("company"), F.col(_K).alias("ord"), F.get(kinds, (F.col("o_custkey") % 9).cast("int")).alias("type"), F.year("o_orderdate").alias("from_year"), (F.year("o_orderdate") + 1).alias("to_year"),
        F.col(_K).alias("i"), F.col("o_custkey").alias("j"), F.floor("o_totalprice").cast("string").alias("detail"), F.struct(F.repeat(F.lit("old "), 100).alias("sentence")).alias("old"), F.struct(F.lit("new").alias("sentence")).alias("new"),
        F.lit("text").alias("matched_via"), F.array().cast("array<string>").alias("matched_slots"),
    )


@query(f"WITH {_EVENT_SQL} SELECT company, i, j, type, rank FROM (SELECT *, row_number() OVER (PARTITION BY company ORDER BY list_position({_KINDS}, type), from_year, i, j) AS rank FROM e) WHERE rank <= 500")
def events_by_priority(spark, sf_dir):
    return matching.by_priority(_events(spark, sf_dir), 500).select("company", "i", "j", "type", "rank")


@query(f"""WITH {_EVENT_SQL}, n AS (SELECT company, type, count(*) AS n FROM e GROUP BY company, type)
SELECT company, sum(n) FILTER (WHERE type <> 'boilerplate_recycled') AS substantive, coalesce(sum(n) FILTER (WHERE type = 'boilerplate_recycled'), 0) AS boilerplate, string_agg(type || '=' || CAST(n AS STRING), ';' ORDER BY type) AS by_type FROM n GROUP BY company""")
def event_counts(spark, sf_dir):
    kinds = F.transform(F.map_entries("by_type"), lambda x: F.concat_ws("=", x["key"], x["value"]))
    return scoring.event_counts(_events(spark, sf_dir)).select("company", "substantive", "boilerplate", F.array_join(kinds, ";").alias("by_type"))


@query(f"""WITH {_EVENT_SQL} SELECT company, company || '-lang-' || printf('%03d', row_number() OVER (PARTITION BY company ORDER BY ord) - 1) AS drift_id, from_year + 1 AS year,
  CASE WHEN type = 'commitment_negated' THEN 'commitment_dropped' ELSE 'wording_softened' END AS type, repeat('old ', 75) AS old, 'new' AS new, '[' || type || '] ' || CAST(floor(o.o_totalprice) AS BIGINT) AS description, CAST(NULL AS INT) AS page, 'text' AS match_basis
FROM e JOIN orders o ON o.o_orderkey = e.ord""")
def contract_events(spark, sf_dir):
    return scoring.contract_events(_events(spark, sf_dir)).select("company", "drift_id", "year", "type", "old", "new", "description", "page", "match_basis")


@query(f"WITH {_CLAIM_SQL} SELECT company, id, rank FROM (SELECT company, id, row_number() OVER (PARTITION BY company ORDER BY coalesce(max_severity, 0) DESC, coalesce(specificity_score, 1), ord) AS rank FROM c) WHERE rank <= 5")
def most_damaging(spark, sf_dir):
    return scoring.most_damaging(_claims(spark, sf_dir)).select("company", "id", "rank")


@query(f"WITH {_CLAIM_SQL} SELECT company, id, rank FROM (SELECT company, id, row_number() OVER (PARTITION BY company ORDER BY max_severity DESC, ord) AS rank FROM c WHERE max_severity > 0) WHERE rank <= 25")
def top_sins(spark, sf_dir):
    return scoring.top_sins(_claims(spark, sf_dir).where("max_severity > 0")).select("company", "id", "rank")


@query(f"WITH {_CLAIM_SQL} SELECT company, id FROM (SELECT company, id, row_number() OVER (PARTITION BY company ORDER BY ord) AS n FROM c WHERE claim_type = 'target') WHERE n <= 20")
def first_links(spark, sf_dir):
    links = linkage.first_links(_claims(spark, sf_dir).where("claim_type = 'target'"))
    return linkage.first_links(links, 20).select("company", "id")


@query(f"WITH {_CLAIM_SQL} SELECT company, count(*) AS n_targets, count(*) FILTER (WHERE negated OR conditional) AS n_excluded FROM c WHERE claim_type = 'target' GROUP BY company")
def excluded_targets(spark, sf_dir):
    return linkage.excluded_targets(_claims(spark, sf_dir))


# ---- scores of the newest report

_CREDIT = Settings().assurance_credit
_LEVEL = "CASE publish_year % 4 WHEN 0 THEN 'reasonable' WHEN 1 THEN 'limited' WHEN 2 THEN 'unspecified' END"
_UNITS = "sum(CAST(round(coalesce(specificity_score, 0) * 1000) AS BIGINT))"
_CHECKED = "quantification_present AND claim_type IN ('target', 'achievement')"
#: Suppliers' nations are the companies, so that there are many, some without material claims.
_BY_NATION = {"company": "CAST(c_nationkey AS STRING)", "publish_year": "CAST(2018 + c_custkey % 6 + c_nationkey % 2 AS INT)", "claim_type": "CASE WHEN c_nationkey % 6 = 0 THEN 'other' WHEN c_custkey % 3 = 0 THEN 'target' WHEN c_custkey % 3 = 1 THEN 'achievement' ELSE 'attribute' END", "specificity_score": "CASE WHEN c_custkey % 7 > 0 THEN CAST(c_custkey % 89 AS DOUBLE) / 100e0 END", "quantification_present": "c_custkey % 4 > 0", "verification_present": "c_custkey % 5 = 0"}


@query(f"""WITH c AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _BY_NATION.items())} FROM customer), n AS (SELECT *, max(publish_year) OVER (PARTITION BY company) AS newest FROM c),
a AS (SELECT company, publish_year, count(*) AS n_claims, count(*) FILTER (WHERE claim_type <> 'other') AS n_material, count(*) FILTER (WHERE {_CHECKED}) AS n_checkable,
  CAST(count(*) FILTER (WHERE {_CHECKED} AND NOT verification_present) AS DOUBLE) AS naked, {_UNITS} AS units, {_UNITS} FILTER (WHERE claim_type <> 'other') AS material FROM n WHERE publish_year = newest GROUP BY company, publish_year),
s AS (SELECT *, {_LEVEL} AS level FROM a),
v AS (SELECT *, units / 1000e0 / n_claims AS every, material / 1000e0 / n_material AS own, naked / n_checkable * CASE level WHEN 'reasonable' THEN {_CREDIT['reasonable']}e0 WHEN 'limited' THEN {_CREDIT['limited']}e0 WHEN 'unspecified' THEN {_CREDIT['unspecified']}e0 ELSE {_CREDIT['none']}e0 END * 100 AS x FROM s),
w AS (SELECT *, (1 - CASE WHEN n_material > 0 THEN own ELSE {py_round_sql('every', 4)} END) * 100 AS y FROM v)
SELECT company, publish_year, n_claims, n_material, n_checkable, {py_round_sql('y', 1)} AS vagueness, CASE WHEN n_checkable > 0 THEN {py_round_sql('x', 1)} END AS unsupported_claims FROM w""")
def language_scores(spark, sf_dir):
    rows = _table(spark, sf_dir, "customer").selectExpr(*(f"{e} AS {n}" for n, e in _BY_NATION.items()))
    assurance = rows.select("company", "publish_year").distinct().withColumn("level", F.expr(_LEVEL)).withColumn("assured", F.col("level").isNotNull())
    return scoring.language_scores(rows, assurance).select("company", "publish_year", "n_claims", "n_material", "n_checkable", "vagueness", "unsupported_claims")


# ---- the document


@query(f"""WITH {_RESTATED}, y AS (SELECT DISTINCT company, year FROM fig), p AS (SELECT company, year, count(*) AS n FROM fig GROUP BY company, year),
d AS (SELECT company, year, string_agg(company || '-' || metric || '-' || CAST(pub AS STRING), ',' ORDER BY company || '-' || metric || '-' || CAST(pub AS STRING)) AS drift FROM restated GROUP BY company, year),
s AS (SELECT company, year, string_agg(claim_id, ',' ORDER BY claim_id) AS said FROM (SELECT *, row_number() OVER (PARTITION BY company, year ORDER BY claim_id) AS k FROM (SELECT 'c' || CAST(o_custkey % 5 AS STRING) AS company, 2000 + CAST(o_orderkey % 33 AS INT) AS year, 'claim-' || CAST(o_orderkey AS STRING) AS claim_id FROM orders)) WHERE k <= 12 GROUP BY company, year)
SELECT y.company, y.year, p.n AS n_points, coalesce(d.drift, '') AS drift_ids, coalesce(s.said, '') AS said_claim_ids FROM y JOIN p ON y.company = p.company AND y.year = p.year LEFT JOIN d ON y.company = d.company AND y.year = d.year LEFT JOIN s ON y.company = s.company AND y.year = s.year""")
def timeline(spark, sf_dir):
    figures = _figures(spark, sf_dir)
    events = facts.restatements(figures).withColumn("drift_id", F.concat_ws("-", "company", "canonical_metric", facts.publish_year(F.col("new_source")).cast("string")))
    said = _table(spark, sf_dir, "orders").selectExpr("'c' || CAST(o_custkey % 5 AS STRING) AS company", "2000 + CAST(o_orderkey % 33 AS INT) AS publish_year", "'claim-' || CAST(o_orderkey AS STRING) AS claim_id")
    out = scoring.timeline(figures, events, said)
    return out.select("company", "year", F.size("did_points").cast("long").alias("n_points"), F.array_join("drift_ids", ",").alias("drift_ids"), F.array_join("said_claim_ids", ",").alias("said_claim_ids"))


_SUMMARY = "CAST(s_suppkey AS STRING) AS company, CASE WHEN s_suppkey % 3 > 0 THEN CAST(s_suppkey % 71 AS DOUBLE) END AS vagueness, CASE WHEN s_suppkey % 5 > 0 THEN 20e0 END AS unsupported_claims, 40e0 AS sins_severity, CASE WHEN s_suppkey % 4 > 0 THEN CAST(s_suppkey % 53 AS DOUBLE) END AS goalpost_drift, CAST(s_suppkey % 7 AS INT) AS n_quotes"
_WEIGHTS = {n: float(w) for n, w in Settings().weights.items()}


@query(f"""WITH s AS (SELECT {_SUMMARY} FROM supplier), b AS (SELECT *, {' + '.join(f'CAST({n} IS NOT NULL AS INT)' for n in _WEIGHTS)} AS n, ({' + '.join(f'coalesce({n} * {w}::DOUBLE, 0)' for n, w in _WEIGHTS.items())}) / ({' + '.join(f'CASE WHEN {n} IS NULL THEN 0e0 ELSE {w}::DOUBLE END' for n, w in _WEIGHTS.items())}) AS x,
  percent_rank() OVER (PARTITION BY goalpost_drift IS NULL ORDER BY goalpost_drift) * 100 AS r FROM s)
SELECT company, CASE WHEN n >= 3 THEN {py_round_sql('x', 1)} END AS overall_score, n < 3 AS abstain, goalpost_drift, CASE WHEN n >= 4 AND n_quotes >= 5 THEN 'high' WHEN n >= 3 AND n_quotes >= 2 THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN goalpost_drift IS NOT NULL THEN {py_round_sql('r', 1)} END AS peer_percentile FROM b""")
def company_index(spark, sf_dir):
    return scoring.company_index(_table(spark, sf_dir, "supplier").selectExpr(*_split(_SUMMARY)))


_MIXED = ("'c' || CAST(user_id % 5 AS STRING)", "2000 + day(ts)", "CASE WHEN event_id % 4 = 0 THEN 'target_' || event_type ELSE event_type END", "2020 + CAST(event_id % 3 AS INT)")


@query(f"""WITH {_figures_sql(_MIXED)} SELECT company, count(DISTINCT source) AS n_reports, count(*) FILTER (WHERE NOT starts_with(metric, 'target_')) AS n_did_rows, array_to_string(list_sort(list(DISTINCT year) FILTER (WHERE NOT starts_with(metric, 'target_'))), ',') AS did_years,
  array_to_string(list_sort(list(DISTINCT metric) FILTER (WHERE NOT starts_with(metric, 'target_'))), ',') AS did_metrics, count(*) FILTER (WHERE starts_with(metric, 'target_')) AS n_target_rows, coalesce(array_to_string(list_sort(list(DISTINCT metric) FILTER (WHERE starts_with(metric, 'target_'))), ','), '') AS target_metrics FROM fig GROUP BY company""")
def data_coverage(spark, sf_dir):
    c = facts.coverage(_figures(spark, sf_dir, _MIXED))
    return c.select("company", "n_reports", "n_did_rows", F.array_join(F.col("did_years").cast("array<string>"), ",").alias("did_years"), F.array_join("did_metrics", ",").alias("did_metrics"), "n_target_rows", F.array_join("target_metrics", ",").alias("target_metrics"))


# ---- events told in words; whole numbers, so that both engines write them alike

_WHOLE = "SELECT 'c' || CAST(user_id % 5 AS STRING) AS company, 2000 + day(ts) AS year, event_type AS metric, 2020 + CAST(event_id % 3 AS INT) AS pub, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY 1, 2, 3, 4"


def _whole(spark: SparkSession, sf_dir: str, prefix: str = "") -> DataFrame:
    f = _table(spark, sf_dir, "events").groupBy(F.expr("'c' || CAST(user_id % 5 AS STRING)").alias("company"), F.expr("2000 + day(ts)").alias("year"), F.concat(F.lit(prefix), "event_type").alias("metric"), F.expr("2020 + CAST(event_id % 3 AS INT)").alias("pub")).agg(F.count("*").cast("double").alias("value"))
    return f.withColumns({"unit": F.lit("u"), "scope": F.lit(None).cast("string"), "source": F.format_string("%s/%d_report.csv", "company", "pub"), "ord": F.col("pub").cast("long"), "page": F.lit(3)})


_STEPS = f"w AS ({_WHOLE}), s AS (SELECT *, lag(value) OVER x AS old, lag(pub) OVER x AS old_pub FROM w WINDOW x AS (PARTITION BY company, year, metric ORDER BY pub)), p AS (SELECT *, (value - old) / abs(old) * 100 AS pct FROM s WHERE old <> value)"
_TOLD = "CAST(CAST({} AS BIGINT) AS STRING)"


@query(f"""WITH {_STEPS} SELECT company, year, metric AS canonical_metric, {_TOLD.format('old')} AS old, {_TOLD.format('value')} AS new,
  metric || ' for ' || CAST(year AS STRING) || ' was published as ' || {_TOLD.format('old')} || ' u in ' || CAST(old_pub AS STRING) || '_report.csv, then restated to ' || {_TOLD.format('value')} || ' u in ' || CAST(pub AS STRING) || '_report.csv' || printf(' (%+.1f%%)', pct) AS description FROM p WHERE abs(pct) >= 0.5""")
def restatement_texts(spark, sf_dir):
    return facts.restatements(_whole(spark, sf_dir)).select("company", "year", "canonical_metric", "old", "new", "description")


@query(f"""WITH {_STEPS} SELECT company, year, 'target_' || metric AS canonical_metric, value < old AS weakened,
  'the ' || CAST(year AS STRING) || ' target for ' || metric || ' was published as ' || {_TOLD.format('old')} || 'u in ' || CAST(old_pub AS STRING) || '_report.csv' || CASE WHEN value < old THEN ', then cut to ' ELSE ', then raised to ' END || {_TOLD.format('value')} || 'u in ' || CAST(pub AS STRING) || '_report.csv' || printf(' (%+.1f%%)', pct) AS description FROM p""")
def target_texts(spark, sf_dir):
    events = facts.target_drift(_whole(spark, sf_dir, "target_")).where("type = 'target_value_changed'")
    return events.select("company", "year", "canonical_metric", "weakened", "description")


# ---- sentences of reports

_OPENINGS = (
    ("Short one.", "length"),
    ("we cut our carbon emissions by 12% in this year.", "shape"),
    ("For our carbon emissions see page 12 of this report.", "navigational"),
    ("The weather was pleasant on most days of the season.", "no candidate"),
    ("We will cut our carbon emissions by {n}% by 2030 against a 2015 baseline.", "kept"),
)


@query("SELECT o_orderpriority AS doc, CASE o_orderkey % 5 " + " ".join(f"WHEN {i} THEN '{r}'" for i, (_, r) in enumerate(_OPENINGS)) + " END AS outcome, count(*) AS n FROM orders GROUP BY 1, 2")
def claim_funnel(spark, sf_dir):
    """Blocks of reports, a sentence each, through boilerplate, sections, gates and slots."""
    return blocks.funnel(blocks.tagged_sentences(_report_blocks(spark, sf_dir)))


@query("SELECT o_orderpriority AS doc, o_orderkey AS page, 'We will cut our carbon emissions by ' || CAST(o_orderkey % 60 + 4 AS STRING) || '% by 2030 against a 2015 baseline.' AS sentence, CAST(o_orderkey % 60 + 4 AS STRING) || '%' AS quantity, '2015' AS baseline, '2030' AS deadline, 'firm' AS strength, 'target' AS claim_type FROM orders WHERE o_orderkey % 5 = 4")
def claims(spark, sf_dir):
    return blocks.claims(_report_blocks(spark, sf_dir)).select("doc", "page", "sentence", "quantity", "baseline", "deadline", "strength", "claim_type")


def _report_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders").selectExpr("o_orderpriority AS doc", "o_orderkey AS page", "CAST(o_orderkey % 5 AS INT) AS k")
    text = F.get(F.array(*(F.lit(t) for t, _ in _OPENINGS)), F.col("k"))
    return o.select("doc", "page", F.lit(0).cast("long").alias("ord"), F.replace(text, F.lit("{n}"), (F.col("page") % 60 + 4).cast("string")).alias("text"), F.lit(10.0).alias("size"), F.lit(False).alias("bold"))


@query("SELECT doc_id, n_chars, md5(trim(regexp_replace(text, '[ \\t\\n\\x0b\\f\\r\\x85\\xA0\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{1680}]+', ' ', 'g'))) AS squeezed FROM documents")
def squeezed_texts(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.md5(squeeze(F.col("text"))).alias("squeezed"))


@query("SELECT conv_id, turn, 'The long-' || CASE WHEN turn % 2 = 0 THEN 'term' ELSE 'lived ' || role END AS joined, CASE WHEN turn % 3 = 0 THEN role || ' said' ELSE '* ' || role || ' said' END AS kept FROM conversations")
def joined_lines(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations")
    # a word broken at a line's end loses its hyphen, so it is written twice there
    lines = F.array(F.lit(" The long--"), F.lit(""), F.when(F.col("turn") % 2 == 0, F.lit("term ")).otherwise(F.concat(F.lit(" lived "), "role")))
    marked = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("(3) "), "role", F.lit(" said"))).otherwise(F.concat(F.lit("* * "), "role", F.lit(" said")))
    return c.select("conv_id", "turn", F.regexp_replace(join_lines(lines), "-+ ?", "-").alias("joined"), without_footnote_mark(marked).alias("kept"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '2030' WHEN 1 THEN '2040' WHEN 2 THEN '' ELSE '2050' END AS due FROM orders")
def leading_deadlines(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").selectExpr("o_orderkey", "CASE o_orderkey % 4 WHEN 0 THEN '2030' ELSE '' END AS deadline", "CASE o_orderkey % 4 WHEN 0 THEN '2045: all' WHEN 1 THEN '2040: net zero' WHEN 2 THEN 'Net zero in time' ELSE '2050: none' END AS s")
    return o.select("o_orderkey", deadline_or_leading(F.col("deadline"), F.col("s")).alias("due"))


@query("SELECT s_suppkey, regexp_replace(lower(s_name || ' & Co. ' || CAST(s_nationkey AS STRING)), '[^a-z0-9]', '', 'g') AS slug FROM supplier")
def slugs(spark, sf_dir):
    s = _table(spark, sf_dir, "supplier")
    return s.select("s_suppkey", slug(F.concat("s_name", F.lit(" & Co. "), F.col("s_nationkey").cast("string"))).alias("slug"))


@query("SELECT conv_id, turn, CAST(turn AS INT) AS first, role AS kind, len(text) AS length, 0 AS unreadable FROM conversations")
def json_columns(spark, sf_dir):
    """Highlights to JSON text and back; text that is no JSON gives none."""
    c = _table(spark, sf_dir, "conversations")
    marks = F.array(F.struct(F.col("turn").cast("int").alias("start"), F.length("text").alias("end"), F.col("role").alias("kind"), F.col("text").alias("term")))
    back = c.select("conv_id", "turn", sources.parsed_highlights(sources.json_text(marks)).alias("h"), sources.parsed_highlights(F.lit("{no json")).alias("none"))
    return back.select("conv_id", "turn", F.col("h")[0]["start"].alias("first"), F.col("h")[0]["kind"].alias("kind"), F.length(F.col("h")[0]["term"]).cast("long").alias("length"), F.size("none").alias("unreadable"))


@query("SELECT doc_id FROM documents ORDER BY md5(CAST(doc_id AS STRING) || '#7'), doc_id LIMIT 20")
def sampled(spark, sf_dir):
    return scoring.sampled(_table(spark, sf_dir, "documents").select("doc_id"), 20, 7, "doc_id")


@query("SELECT c_custkey, c_mktsegment AS company FROM customer WHERE c_mktsegment IN (SELECT DISTINCT c_mktsegment FROM customer ORDER BY 1 LIMIT 2)")
def first_companies(spark, sf_dir):
    return scoring.first_companies(_table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("company")), 2)


# ---- assurance and pages of tables

_PAGE = "'Page ' || CAST(o_orderkey AS STRING) || CASE WHEN o_orderkey % 50 = 0 THEN ' has limited assurance by KPMG on it' WHEN o_orderkey % 70 = 0 THEN ' has reasonable assurance by DNV on it' ELSE ' has none' END"


@query("""WITH p AS (SELECT o_custkey AS doc, o_orderkey AS page, o_orderkey % 50 = 0 AS l, o_orderkey % 50 <> 0 AND o_orderkey % 70 = 0 AS r FROM orders), g AS (SELECT doc, bool_or(l) AS l, bool_or(r) AS r, min(page) FILTER (WHERE l OR r) AS page FROM p GROUP BY doc)
SELECT doc, l OR r AS assured, page, CASE WHEN page % 50 = 0 THEN 'KPMG' WHEN page IS NOT NULL THEN 'DNV' END AS auditor, CASE WHEN l THEN 'limited' WHEN r THEN 'reasonable' END AS level,
  CASE WHEN page % 50 = 0 THEN 'Page ' || CAST(page AS STRING) || ' has limited assurance by KPMG on it' WHEN page IS NOT NULL THEN 'Page ' || CAST(page AS STRING) || ' has reasonable assurance by DNV on it' END AS quote FROM g""")
def assurance(spark, sf_dir):
    pages = _table(spark, sf_dir, "orders").selectExpr("o_custkey AS doc", "o_orderkey AS page", f"{_PAGE} AS page_text")
    return features.assurance(pages).select("doc", "assured", "page", "auditor", "level", "quote")


@query("SELECT doc, array_to_string(list(page ORDER BY page), ',') AS pages FROM (SELECT o_custkey AS doc, CAST(o_orderkey AS STRING) AS page FROM orders WHERE o_orderkey % 4 = 0) GROUP BY doc")
def empty_pages(spark, sf_dir):
    pages = _table(spark, sf_dir, "orders").selectExpr("o_custkey AS doc", "CAST(o_orderkey AS STRING) AS page", "CASE o_orderkey % 4 WHEN 0 THEN ' ' ELSE 'text' END AS page_text")
    return blocks.empty_pages(pages).where(F.size("pages") > 0).select("doc", F.array_join("pages", ",").alias("pages"))


_LINE = "CASE l_linenumber WHEN 1 THEN 'Total scope' WHEN 2 THEN CASE WHEN CAST(l_quantity AS INT) % 3 = 0 THEN '1 emissions' ELSE 'x emissions' END WHEN 3 THEN CASE WHEN CAST(l_quantity AS INT) % 2 = 0 THEN 'FY2020 2021 2022' ELSE '2020 2021' END ELSE 'end' END"


@query("""WITH a AS (SELECT l_orderkey % 300 AS doc, l_orderkey AS page, bool_or(l_linenumber = 1) AND bool_or(l_linenumber = 2 AND CAST(l_quantity AS INT) % 3 = 0) AS label, bool_or(l_linenumber = 3 AND CAST(l_quantity AS INT) % 2 = 0) AS header FROM lineitem GROUP BY l_orderkey)
SELECT doc, page FROM (SELECT doc, page, row_number() OVER (PARTITION BY doc ORDER BY page) AS n FROM a WHERE label AND header) WHERE n <= 5""")
def table_pages(spark, sf_dir):
    """Pages whose label runs over two rows and whose header has three years; five a document."""
    rows = _table(spark, sf_dir, "lineitem").selectExpr("l_orderkey % 300 AS doc", "l_orderkey AS page", "l_linenumber AS row", f"{_LINE} AS text")
    return tables.candidate_pages(rows)


@query("SELECT l_orderkey AS doc, l_linenumber AS page, l_quantity AS value, row_number() OVER (PARTITION BY l_orderkey ORDER BY metric, l_linenumber, l_partkey, l_suppkey, l_quantity) AS rank FROM (SELECT *, l_returnflag || l_linestatus AS metric FROM lineitem) WHERE l_linestatus = 'O'")
def draft_order(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS doc", "l_linenumber AS page", "named_struct('part', l_partkey, 'supplier', l_suppkey, 'quantity', l_quantity) AS row", "l_returnflag || l_linestatus AS metric", "2020 AS year", "l_quantity AS value", "CASE l_linestatus WHEN 'O' THEN 'ok' ELSE 'rejected' END AS status")
    return tables.in_order(rows).select("doc", "page", "value", "rank")


# ---- features of four sentences, worked out by hand

_SAID = ("We may improve significantly.", "We will cut Scope 1 emissions by 40% by 2030.", "Waste was reduced and verified by an independent body.", "Proud and excited teams saved 10%.")
_WORKED = {
    "n_words": (4, 7, 9, 5), "vague_ratio": ("0.5e0", "0e0", "0e0", "0e0"), "hedging_ratio": ("0.25e0", "0e0", "0e0", "0e0"), "future_ratio": ("0e0", "0.3057e0", "0e0", "0e0"), "verification_present": ("false", "false", "true", "false"),
    "sentiment": ("0e0", "0e0", "0e0", "0.4e0"), "specificity_score": ("0e0", "0.6e0", "0.2e0", "0.2e0"), "readability": ("12.4e0", "91e0", "37.9e0", "66.4e0"), "passive_voice": ("false", "false", "true", "false"),
    "modal_firm": ("false", "true", "false", "false"), "modal_soft": ("true", "false", "false", "false"), "positive_tone_words": (0, 0, 0, 2), "strength": ("'hedged'", "'firm'", "'achievement'", "''"), "quantity": ("''", "'40%'", "''", "'10%'"),
}
_PICK = lambda values: "CASE o_orderkey % 4 " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"
_FEATURED = f"f AS (SELECT o_orderkey AS id, o_orderpriority AS company, year(o_orderdate) AS publish_year, {', '.join(f'{_PICK(v)} AS {n}' for n, v in _WORKED.items())} FROM orders)"


def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features of each sentence, worked out once, on the orders that say it."""
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(_SAID)], "k int, sentence string")
    known = features.with_features(with_slots(rows, Lexicon()))
    o = _table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "o_orderpriority AS company", "year(o_orderdate) AS publish_year", "CAST(o_orderkey % 4 AS INT) AS k")
    return o.join(F.broadcast(known), "k")


@query(f"WITH {_FEATURED} SELECT id, {', '.join(_WORKED)} FROM f")
def claim_features(spark, sf_dir):
    return _said(spark, sf_dir).select("id", *_WORKED)


_MEAN = {"vague_ratio": 4, "hedging_ratio": 4, "future_ratio": 4, "sentiment": 4, "readability": 1}


@query(f"""WITH {_FEATURED}, a AS (SELECT company, publish_year, count(*) AS n, {', '.join(f'sum(CAST(round({c} * {10**d}) AS BIGINT)) / {10**d}e0 / count(*) AS {c}' for c, d in _MEAN.items())},
  CAST(sum(positive_tone_words) AS DOUBLE) / nullif(count(*) FILTER (WHERE quantity <> ''), 0) AS more, CAST(count(*) FILTER (WHERE verification_present) AS DOUBLE) / count(*) AS v, CAST(count(*) FILTER (WHERE passive_voice) AS DOUBLE) / count(*) AS p FROM f GROUP BY company, publish_year)
SELECT company, publish_year, n AS n_claims, {', '.join(f"{py_round_sql(c, d)} AS {'mean_sentiment' if c == 'sentiment' else c}" for c, d in _MEAN.items())}, {py_round_sql('more', 2)} AS say_more_prove_less, {py_round_sql('v', 3)} AS verified_share, {py_round_sql('p', 3)} AS passive_share FROM a""")
def year_means(spark, sf_dir):
    series = features.year_series(_said(spark, sf_dir))
    return series.select("company", "publish_year", "n_claims", "vague_ratio", "hedging_ratio", "future_ratio", "mean_sentiment", "readability", "say_more_prove_less", "verified_share", "passive_share")


@query(f"""WITH {_FEATURED}, y AS (SELECT company, publish_year, round(avg(CASE WHEN strength = 'firm' THEN 1e0 ELSE 0e0 END), 3) AS x FROM f GROUP BY company, publish_year)
SELECT company, arg_min(x, publish_year) AS first, arg_max(x, publish_year) AS last, round(arg_max(x, publish_year) - arg_min(x, publish_year), 3) AS delta FROM y GROUP BY company""")
def trends(spark, sf_dir):
    said = _said(spark, sf_dir).withColumn("negated", F.lit(False))
    return features.trend(features.year_series(said), "firm_share").withColumn("delta", F.round("delta", 3))
