"""Rules that tag claims with ways to mislead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import fixed, py_round

LEAST_SPECIFIC, ENOUGH_TO_PROVE = 0.25, 0.20
# ---- fixed patterns
CERTIFIED = r"(?iu)\b(certifi\w*|accredit\w*|standard|verified|approved|compliant|label|seal|audited|assured)\b"
BODIES = (
    r"(?iu)\b(SBTi|Science[- ]Based Targets|GOTS|FSC|PEFC|OEKO|RWS|RMS|GRS|RCS|BCI|Cradle to Cradle|ISO\s?\d{4,5}|GHG Protocol|CDP|GRI|TCFD|SASB|Bluesign|Fairtrade|Rainforest Alliance|B Corp|EPEAT|"
    r"Energy Star|LEED|BREEAM|Textile Exchange|Higg|ZDHC|RE100|Deloitte|EY|KPMG|PwC|Ernst|Bureau Veritas|SGS|DNV|TÜV|Intertek)\b"
)
IMPROVEMENT = (
    r"(?iu)\b(reduc\w+|cut|lower\w*|decreas\w+|improv\w+|increas\w+ (?:the )?(?:share|use|proportion)|saved?|avoided|eliminat\w+|phased? out|switch\w+ to|transition\w+ to|achiev\w+|progress|milestone|on track)\b"
)


def tags(worsening: Column) -> Column:
    """array of struct(sin, rationale, severity, evidence_needed) of a row with features; ``worsening``: total emissions rose in its report's year."""
    c, no = F.col, F.lit(False)
    s = F.coalesce("sentence", F.lit(""))
    spec, soft = F.coalesce("specificity_score", F.lit(0.0)), F.coalesce("vague_ratio", F.lit(0.0)) + F.coalesce("hedging_ratio", F.lit(0.0))
    is_true = lambda n: F.coalesce(c(n), no)
    verified, quantified = is_true("verification_present"), is_true("quantification_present")

    def tag(test: Column, sin: str, rationale: Column, severity: Column, needed: str) -> Column:
        return F.when(test, F.struct(F.lit(sin).alias("sin"), rationale.alias("rationale"), severity.alias("severity"), F.lit(needed).alias("evidence_needed")))

    vague = F.least(F.lit(1.0), F.lit(0.30) + F.least(soft, F.lit(0.08)) * 5.0 + (F.lit(LEAST_SPECIFIC) - spec))
    unproven = F.lit(0.35) + F.when(is_true("scope_present"), 0.2).otherwise(0.0) + F.when(is_true("date_present"), 0.15).otherwise(0.0)
    return F.array_compact(F.array(
        tag((spec <= LEAST_SPECIFIC) & (soft > 0) & ~quantified, "vagueness", F.concat(F.lit("no quantification and specificity "), fixed(spec, 2), F.lit("; relies on vague/hedging vocabulary (ratio "), fixed(soft, 3), F.lit(")")), py_round(vague, 2), "a number, a boundary/scope, and a baseline year"),
        tag(~verified & quantified & (spec >= ENOUGH_TO_PROVE), "no_proof", F.lit("states a measurable outcome but names no assurance, audit, standard or third-party verifier"), py_round(F.least(unproven, F.lit(1.0)), 2), "an assurance statement or named third-party verifier for this figure"),
        tag(s.rlike(CERTIFIED) & ~s.rlike(BODIES), "false_labels", F.concat(F.lit("uses certification-style wording ('"), F.regexp_extract(s, CERTIFIED, 0), F.lit("') without naming the certifying body or standard")), F.when(verified, 0.45).otherwise(0.6), "the name of the certifying organisation and the standard applied"),
        tag(F.coalesce(worsening, no) & quantified & ~is_true("negated") & s.rlike(IMPROVEMENT), "hidden_trade_off", F.concat(F.lit("advertises an improvement ('"), F.regexp_extract(s, IMPROVEMENT, 0), F.lit("') in a report year when the company's own verified data shows TOTAL emissions rose")), F.lit(0.5), "total-footprint context presented alongside the highlighted metric"),
    ))


def tagged(features: DataFrame, worsening: DataFrame) -> DataFrame:
    """Claims with any tag, and max_severity.  ``worsening``: (company, year)."""
    marked = worsening.select("company", F.col("year").alias("publish_year")).distinct().withColumn("_worse", F.lit(True))
    out = features.join(marked, ["company", "publish_year"], "left").withColumn("sins", tags(F.col("_worse"))).drop("_worse")
    return out.where(F.size("sins") > 0).withColumn("max_severity", F.array_max(F.transform("sins", lambda t: t["severity"])))


def sin_scores(features: DataFrame, tagged: DataFrame) -> DataFrame:
    """company, n_claims, n_tagged, sins_severity: summed greatest severities per claim, of 100; null without claims."""
    n = features.groupBy("company").agg(F.count("*").alias("n_claims"))
    t = tagged.groupBy("company").agg(F.count("*").alias("n_tagged"), (F.sum(F.round(F.col("max_severity") * 100).cast("long")) / 100.0).alias("_sum"))
    out = n.join(t, "company", "left").fillna({"n_tagged": 0, "_sum": 0.0})
    return out.withColumn("sins_severity", py_round(F.col("_sum") / F.col("n_claims") * 100, 1)).drop("_sum")


def sin_counts(tagged: DataFrame) -> DataFrame:
    return tagged.select("company", F.explode("sins.sin").alias("sin")).groupBy("company", "sin").agg(F.count("*").alias("n"))
