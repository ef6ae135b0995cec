"""Sub-scores, their blend, and the assembly of one nested document for each company."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicon import Settings
from ..functions.numbers import py_round

SUB_SCORES = ("vagueness", "unsupported_claims", "sins_severity", "goalpost_drift")
MATERIAL = ("target", "achievement", "attribute")
WEAK_EVENTS = ("boilerplate_recycled",)


def credit(level: Column, assured: Column, settings: Settings = Settings()) -> Column:
    """What third-party assurance takes off unsupported claims; 1 without it."""
    c = settings.assurance_credit
    out = F.lit(c["unspecified"])
    for name in ("reasonable", "limited"):
        out = F.when(level == name, c[name]).otherwise(out)
    return F.when(F.coalesce(assured, F.lit(False)), out).otherwise(c["none"])


def language_scores(features: DataFrame, assurance: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """company, vagueness, unsupported_claims from each company's newest report's material claims.

    Without material claims vagueness falls back on all claims of that report;
    unsupported claims are null where nothing is checkable.  ``assurance`` has
    company, publish_year, assured, level.
    """
    newest = F.max("publish_year").over(Window.partitionBy("company"))
    last = features.withColumn("_new", newest).where(F.col("publish_year") == F.col("_new")).drop("_new")
    kind = F.col("claim_type")
    fine = kind.isin(*MATERIAL)
    checkable = F.col("quantification_present") & kind.isin("target", "achievement")
    units = lambda when: F.sum(F.when(when, F.round(F.coalesce("specificity_score", F.lit(0.0)) * 1000).cast("long"))) / F.lit(1000.0) / F.count_if(when)
    out = last.groupBy("company", "publish_year").agg(
        F.count("*").alias("n_claims"), F.count_if(fine).alias("n_material"), F.count_if(fine & checkable).alias("n_checkable"), F.count_if(fine & checkable & ~F.col("verification_present")).alias("_naked"),
        units(fine).alias("_material"), units(F.lit(True)).alias("_all"),
    )
    out = out.join(assurance.select("company", "publish_year", "assured", "level"), ["company", "publish_year"], "left")
    vague = F.when(F.col("n_material") > 0, F.col("_material")).otherwise(py_round(F.col("_all"), 4))
    naked = F.when(F.col("n_checkable") > 0, F.col("_naked") / F.col("n_checkable") * credit(F.col("level"), F.col("assured"), settings) * 100)
    return out.withColumn("vagueness", py_round((1 - vague) * 100, 1)).withColumn("unsupported_claims", py_round(naked, 1)).drop("_material", "_all", "_naked")


def blended(scores: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``scores`` with n_measured, missing and overall: the weighted mean of the sub-scores there are; null under the least number."""
    live = F.filter(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("score"), F.lit(float(settings.weights[n])).alias("weight")) for n in SUB_SCORES)), lambda s: s["score"].isNotNull())
    total = F.aggregate(live, F.lit(0.0), lambda a, s: a + s["score"] * s["weight"])
    weight = F.aggregate(live, F.lit(0.0), lambda a, s: a + s["weight"])
    missing = F.array_compact(F.array(*(F.when(F.col(n).isNull(), n) for n in SUB_SCORES)))
    return scores.withColumn("n_measured", F.size(live)).withColumn("missing", missing).withColumn("overall", F.when(F.size(live) >= settings.min_components, py_round(total / weight, 1)))


def confidence(n_measured: Column, n_quotes: Column, settings: Settings = Settings()) -> Column:
    s = settings
    return (
        F.when((n_measured >= s.components_for_high) & (n_quotes >= s.quotes_for_high), "high")
        .when((n_measured >= s.components_for_medium) & (n_quotes >= s.quotes_for_medium), "medium")
        .otherwise("low")
    )


def with_percentile(scores: DataFrame, score: str, over: tuple[str, ...] = ()) -> DataFrame:
    """``scores`` with peer_percentile: the share of the measurable others below; null for the unmeasurable, and without peers.

    The window is over one row for each company, not over their data.
    """
    measurable = F.col(score).isNotNull()
    peers = Window.partitionBy(*over, measurable)
    rank = F.percent_rank().over(peers.orderBy(score))
    return scores.withColumn("peer_percentile", F.when(measurable & (F.count("*").over(peers) > 1), py_round(rank * 100, 1)))


def event_counts(events: DataFrame) -> DataFrame:
    """company, substantive, boilerplate, by_type."""
    n = events.groupBy("company", "type").agg(F.count("*").alias("n"))
    weak = F.col("type").isin(*WEAK_EVENTS)
    return n.groupBy("company").agg(F.coalesce(F.sum(F.when(~weak, F.col("n"))), F.lit(0)).alias("substantive"), F.coalesce(F.sum(F.when(weak, F.col("n"))), F.lit(0)).alias("boilerplate"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "n")))).alias("by_type"))


def cross_signal(numeric: DataFrame, language: DataFrame) -> DataFrame:
    """Restated figures and softened claims by the report that made the change: company, report_year, both counts, both."""
    a = numeric.where("report_year is not null").groupBy("company", "report_year").agg(F.count("*").alias("numeric_restatements"))
    b = language.where(~F.col("type").isin(*WEAK_EVENTS)).groupBy("company", F.col("to_year").alias("report_year")).agg(F.count("*").alias("language_softenings"))
    out = a.join(b, ["company", "report_year"], "full_outer").fillna(0, ["numeric_restatements", "language_softenings"])
    return out.withColumn("both", (F.col("numeric_restatements") > 0) & (F.col("language_softenings") > 0))


def top_claims(claims: DataFrame, most: int = 220) -> DataFrame:
    """Claims by specificity, then in their order, at most so many for each company; those of no kind only where a company has no others."""
    # ranked within kind and others apart, so that each split gives up all but its first rows before the shuffle
    is_other = F.coalesce(F.col("claim_type") == "other", F.lit(False))
    per = Window.partitionBy("company", "_other").orderBy(F.col("specificity_score").desc_nulls_last(), "ord")
    out = claims.withColumn("_other", is_other).withColumn("rank", F.row_number().over(per)).where(F.col("rank") <= most)
    # at most twice ``most`` rows of a company are left
    least = F.min("_other").over(Window.partitionBy("company"))
    return out.withColumn("_least", least).where(F.col("_other") == F.col("_least")).drop("_other", "_least")


def most_damaging(claims: DataFrame, most: int = 5) -> DataFrame:
    """Claims of the greatest severity, then the least specific (null counts as 1)."""
    order = Window.partitionBy("company").orderBy(F.coalesce("max_severity", F.lit(0.0)).desc(), F.coalesce("specificity_score", F.lit(1.0)), "ord")
    return claims.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def top_sins(tagged: DataFrame, most: int = 25) -> DataFrame:
    """Tagged claims of the greatest severity, in their order where equal."""
    order = Window.partitionBy("company").orderBy(F.col("max_severity").desc(), "ord")
    return tagged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


#: How kinds of events and claims are named in the document.
NAMED = {"commitment_negated": "commitment_dropped"}
CLAIM_TYPES = {"target": "target", "achievement": "achievement", "attribute": "product_label"}


def contract_events(events: DataFrame) -> DataFrame:
    """Language events (ord: their place) as the document has them: two kinds, texts of at most 300 characters, and no page (it is text in the source)."""
    kind = F.when(F.col("type") == "commitment_negated", NAMED["commitment_negated"]).otherwise("wording_softened")
    number = F.row_number().over(Window.partitionBy("company").orderBy("ord")) - 1
    return events.select(
        "company", F.format_string("%s-lang-%03d", "company", number).alias("drift_id"), F.col("to_year").alias("year"), kind.alias("type"), F.lit(None).cast("string").alias("canonical_metric"),
        F.substring("old.sentence", 1, 300).alias("old"), F.substring("new.sentence", 1, 300).alias("new"), F.lit(None).cast("double").alias("magnitude_pct"),
        F.format_string("[%s] %s", "type", "detail").alias("description"), F.lit(None).cast("int").alias("page"), F.col("matched_via").alias("match_basis"), "matched_slots",
    )


FEATURES = ("vague_ratio", "hedging_ratio", "future_ratio", "quantification_present", "baseline_present", "date_present", "scope_present", "verification_present", "specificity_score", "readability", "sentiment", "negated", "conditional", "highlights", "report_assured")


def contract_claims(claims: DataFrame) -> DataFrame:
    """Claims as the document has them, from :func:`top_claims` (rank) and :func:`with_sins_and_links` (sins, link).

    The target's value is the quantity where that is a number, else the first
    number in it; years and pages are those that are digits alone.
    """
    c = F.col
    kinds = F.lit("general")
    for name, named in CLAIM_TYPES.items():
        kinds = F.when(c("claim_type") == name, named).otherwise(kinds)
    digits = lambda n: F.when(c(n).cast("string").rlike("^[0-9]+$"), c(n).try_cast("int"))
    value = F.coalesce(c("quantity").try_cast("double"), F.replace(F.regexp_extract("quantity", r"[\d,.]+", 0), F.lit(","), F.lit("")).try_cast("double"))
    name = F.regexp_extract(F.coalesce("source_file", F.lit("")), "[^/]*$", 0)
    features = F.struct(*(c(f).alias("vague_word_ratio" if f == "vague_ratio" else "future_orientation_ratio" if f == "future_ratio" else f) for f in FEATURES if f in claims.columns))
    null = F.lit(None)
    return claims.select(
        "company", F.format_string("%s-claim-%04d", "company", c("rank") - 1).alias("claim_id"), c("sentence").alias("claim_text"), kinds.alias("claim_type"), c("link.family").alias("metric"), c("link.metric").alias("canonical_metric"),
        value.alias("target_value"), null.cast("string").alias("unit"), digits("baseline").alias("baseline_year"), digits("deadline").alias("target_year"), F.nullif(c("scope"), F.lit("")).alias("scope"),
        F.coalesce("verification_present", F.lit(False)).alias("has_third_party_verification"), null.cast("string").alias("verifier_name"), F.concat(name, F.lit("#p"), F.coalesce(c("page").cast("string"), F.lit("None"))).alias("chunk_id"), name.alias("doc_name"),
        "publish_year", digits("page").alias("page"), features.alias("features"), F.coalesce("sins", F.array().cast(claims.schema["sins"].dataType)).alias("sins"), F.array().cast("array<string>").alias("evidence_ids"), c("link.status").alias("progress_status"), null.cast("string").alias("debate"),
    )


def with_sins_and_links(claims: DataFrame, tagged: DataFrame, links: DataFrame) -> DataFrame:
    """``claims`` (company, sentence) with all sins tagged for the sentence, in the order of ``ord``, and the status of its last link."""
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("ord", "sins"))), lambda t: t["sins"])
    sins = tagged.groupBy("company", "sentence").agg(F.flatten(in_order).alias("sins"))
    last = links.groupBy("company", "sentence").agg(F.max_by(F.struct("status", "family", "metric"), F.col("ord")).alias("link"))
    return claims.join(sins, ["company", "sentence"], "left").join(last, ["company", "sentence"], "left")


def timeline(figures: DataFrame, events: DataFrame, claims: DataFrame, most: int = 12) -> DataFrame:
    """company, year, did_points, drift_ids, said_claim_ids for each year of a company's figures.

    did_points are the year's figures as told now, drift_ids the events about
    the year, said_claim_ids the first claims published in it.
    """
    years = figures.select("company", "year").distinct()
    points = figures.groupBy("company", "year").agg(F.sort_array(F.collect_list(F.struct("metric", "value"))).alias("did_points"))
    drift = events.groupBy("company", "year").agg(F.sort_array(F.collect_list("drift_id")).alias("drift_ids"))
    # only the first ids of each year are ever put together
    first = F.row_number().over(Window.partitionBy("company", "publish_year").orderBy("claim_id"))
    said = claims.withColumn("_n", first).where(F.col("_n") <= most).groupBy("company", F.col("publish_year").alias("year")).agg(F.sort_array(F.collect_list("claim_id")).alias("said_claim_ids"))
    out = years.join(points, ["company", "year"], "left").join(drift, ["company", "year"], "left").join(said, ["company", "year"], "left")
    none = F.array().cast("array<string>")
    return out.withColumns({c: F.coalesce(c, none) for c in ("drift_ids", "said_claim_ids")})


def company_index(summaries: DataFrame) -> DataFrame:
    """One line for each company of ``summaries`` (company, the sub-scores, n_quotes): scores, abstention, confidence, and its place among its peers."""
    s = blended(summaries)
    s = with_percentile(s, "goalpost_drift")
    return s.select("company", F.col("overall").alias("overall_score"), F.col("overall").isNull().alias("abstain"), "goalpost_drift", confidence(F.col("n_measured"), F.col("n_quotes")).alias("confidence"), "peer_percentile")


def first_companies(rows: DataFrame, most: int) -> DataFrame:
    """Rows of the first companies by name."""
    return rows.join(F.broadcast(rows.select("company").distinct().orderBy("company").limit(most)), "company", "left_semi")


def sampled(rows: DataFrame, most: int, seed: int, by: str = "id") -> DataFrame:
    """``most`` rows, those whose id and seed have the least hash: the same however the rows are partitioned."""
    return rows.orderBy(F.md5(F.concat_ws("#", F.col(by).cast("string"), F.lit(str(seed)))), by).limit(most)


def documents(companies: DataFrame, **parts: DataFrame) -> DataFrame:
    """One nested row for each company: each part (with a column company) as an ordered array of its rows."""
    out = companies.select("company").distinct()
    for name, rows in parts.items():
        own = [c for c in rows.columns if c != "company"]
        nested = rows.groupBy("company").agg(F.sort_array(F.collect_list(F.struct(*own))).alias(name))
        out = out.join(nested, "company", "left").withColumn(name, F.coalesce(name, F.array().cast(nested.schema[name].dataType)))
    return out
