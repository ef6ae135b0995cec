"""Targets in words against measured series: families, required levels, and the say-do score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicon import UP_FAMILIES, Lexicon, Settings
from ..functions.numbers import py_round
from ..functions.text import BEGIN, END, java
from .facts import latest_by_year

# ---- fixed patterns
NUMBER = r"[\d,.]+"
REDUCTION = r"(?iu)\b(reduc\w+|cut|lower\w*|decreas\w+|declin\w+|drop\w*)\b"
OFF_TOPIC = r"(?iu)\b(food waste|concrete|xbox|hq2|cars? off the road|standby mode|this building|this store|this facility)\b"


def family(s: Column, lexicon: Lexicon = Lexicon(), near: int = Settings.near) -> Column:
    """The first family, in the list's order, of which a phrase lies near the first number or verb of reduction; null if none, or off topic.

    Without a number or verb any place will do.  A phrase's first place counts.
    """
    number, verb = F.regexp_instr(s, F.lit(NUMBER)), F.regexp_instr(s, F.lit(REDUCTION))
    found = []
    for name, phrases in lexicon.families:
        hit = F.lit(False)
        for p in phrases:
            at = F.regexp_instr(s, F.lit("(?iu)" + BEGIN + java(p) + END))
            close = ((number > 0) & (F.abs(at - number) <= near)) | ((verb > 0) & (F.abs(at - verb) <= near)) | ((number == 0) & (verb == 0))
            hit = hit | ((at > 0) & close)
        found.append(F.when(hit, name))
    return F.when(~s.rlike(OFF_TOPIC), F.coalesce(*found))


def metric_of_family(family: Column, metric: Column) -> Column:
    """Whether a metric's name belongs to a family."""
    begins = lambda p: F.startswith(metric, F.lit(p))
    return (
        F.when(family == "total_emissions", begins("total_emissions") | (metric == "scope_1_2_emissions"))
        .when(family.isin("scope_3", "scope_2"), F.startswith(metric, family))
        .when(family == "scope_1", metric == "scope_1_emissions")
        .when(family == "recycled_share", begins("recycled"))
        .when(family == "renewable_share", begins("renewable"))
        .when(family == "carbon_intensity", F.contains(metric, F.lit("intensity")))
        .otherwise(False)
    )


def resolved_metrics(metrics: DataFrame, lexicon: Lexicon = Lexicon()) -> DataFrame:
    """company, family, metric: of a family's metrics the one with the shortest name, then the first."""
    families = F.explode(F.array(*(F.lit(n) for n, _ in lexicon.families)))
    both = metrics.select("company", "metric").distinct().withColumn("family", families)
    both = both.where(metric_of_family(F.col("family"), F.col("metric")))
    return both.groupBy("company", "family").agg(F.min_by("metric", F.struct(F.length("metric"), F.col("metric"))).alias("metric"))


def parsed_quantity(q: Column) -> Column:
    """struct(value, is_percent); value null where there is no number."""
    digits = F.replace(F.regexp_extract(q, NUMBER, 0), F.lit(","), F.lit(""))
    return F.struct(digits.try_cast("double").alias("value"), F.coalesce(q.rlike(r"(?iu)%|per\s*cent"), F.lit(False)).alias("is_percent"))


def glidepath(links: DataFrame) -> DataFrame:
    """``links`` with actual, actual_year, required, elapsed, gap, direction and status; status is null where it can't be measured.

    A link has family, target, is_percent, baseline, deadline (ints or null),
    as_of and series: an array of struct(year, value, unit) in order of year.
    The way from the baseline's level to the target is straight.  A share is a
    level to reach; all else a percentage to cut, for which a target in other
    units or a baseline of 0 is no measure.
    """
    c = F.col
    known = F.filter(c("series"), lambda p: p["year"] <= c("as_of"))
    now = F.when(F.size(known) > 0, F.element_at(known, -1)).otherwise(F.element_at(c("series"), -1))
    at_base = F.filter(c("series"), lambda p: p["year"] == c("baseline"))
    base = F.when(F.size(at_base) > 0, F.get(at_base, F.lit(0))).otherwise(F.get(c("series"), F.lit(0)))
    up = c("family").isin(*UP_FAMILIES)
    out = links.withColumn("_now", now).withColumn("_base", base)
    start, target, actual = c("_base.value"), c("target"), c("_now.value")
    elapsed = F.when(c("deadline") > c("_base.year"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), (c("as_of") - c("_base.year")) / (c("deadline") - c("_base.year"))))).otherwise(F.lit(1.0))
    unit = F.coalesce(F.element_at(c("series"), -1)["unit"], F.lit(""))
    fine = (F.size("series") > 0) & F.when(up, c("is_percent") | F.contains(unit, F.lit("%"))).otherwise(c("is_percent") & (start != 0))
    out = out.withColumn("_elapsed", elapsed).withColumn("_fine", F.coalesce(fine, F.lit(False)))
    required = F.when(up, start + (target - start) * c("_elapsed")).otherwise(start * (1 - target / 100 * c("_elapsed")))
    out = out.withColumn("_required", required)
    late = F.coalesce(c("as_of") >= c("deadline"), F.lit(False)) & (actual < target)
    status = F.when(up, F.when((actual >= c("_required")) & ~late, "on_track").otherwise("behind")).otherwise(F.when(actual <= c("_required"), "on_track").otherwise("behind"))
    only = lambda x: F.when(c("_fine"), x)
    return out.withColumns({
        "status": only(status), "actual": only(actual), "actual_year": only(c("_now.year")), "required": py_round(only(c("_required")), 3), "elapsed": py_round(only(c("_elapsed")), 3),
        "gap": py_round(only(F.when(up, actual - c("_required"))), 3), "actual_pct_vs_baseline": py_round(only(F.when(~up, (actual - start) / F.abs(start) * 100)), 2), "direction": only(F.when(up, "up").otherwise("down")),
    }).drop("_now", "_base", "_elapsed", "_fine", "_required")


def series_arrays(figures: DataFrame) -> DataFrame:
    """company, metric, series: each metric's values by year, as the newest report tells each year."""
    rows = latest_by_year(figures)
    return rows.groupBy("company", "metric").agg(F.sort_array(F.collect_list(F.struct("year", "value", "unit"))).alias("series"))


def say_do_links(claims: DataFrame, figures: DataFrame, lexicon: Lexicon = Lexicon()) -> DataFrame:
    """Targets tied to a series, each with its status; negated and conditional ones are no commitments and are left out."""
    targets = claims.where((F.col("claim_type") == "target") & ~F.coalesce("negated", F.lit(False)) & ~F.coalesce("conditional", F.lit(False)))
    targets = targets.withColumn("family", family(F.col("sentence"), lexicon)).where("family is not null")
    targets = targets.withColumn("_q", parsed_quantity(F.coalesce("quantity", F.lit("")))).withColumn("target", F.col("_q.value")).withColumn("is_percent", F.col("_q.is_percent")).drop("_q").where("target is not null")
    as_of = figures.groupBy("company").agg(F.max("year").alias("as_of"))
    tied = targets.join(resolved_metrics(figures, lexicon), ["company", "family"]).join(series_arrays(figures), ["company", "metric"]).join(as_of, "company")
    tied = tied.withColumns({c: F.col(c).try_cast("int") for c in ("baseline", "deadline")})
    return glidepath(tied).where("status is not null")


def excluded_targets(claims: DataFrame) -> DataFrame:
    """company, n_targets, n_excluded: targets, and those of them that are negated or conditional and so tied to nothing."""
    no_commitment = F.coalesce("negated", F.lit(False)) | F.coalesce("conditional", F.lit(False))
    return claims.where("claim_type = 'target'").groupBy("company").agg(F.count("*").alias("n_targets"), F.count_if(no_commitment).alias("n_excluded"))


def say_do_score(links: DataFrame, companies: DataFrame, least: int = Settings.min_links) -> DataFrame:
    """company, n_measurable, n_behind, say_do_gap: null with too few links or with shares alone."""
    per = links.groupBy("company").agg(F.count("*").alias("n_measurable"), F.count_if(F.col("status") != "on_track").alias("n_behind"), F.bool_and(F.col("family").isin(*UP_FAMILIES)).alias("only_shares"))
    out = companies.select("company").distinct().join(per, "company", "left").fillna({"n_measurable": 0, "n_behind": 0})
    gap = F.when((F.col("n_measurable") >= least) & ~F.col("only_shares"), py_round(F.lit(100.0) * F.col("n_behind") / F.col("n_measurable"), 1))
    return out.withColumn("say_do_gap", gap).drop("only_shares")


def first_links(links: DataFrame, most: int = 40) -> DataFrame:
    """The first links of each company, in the order of its claims."""
    order = Window.partitionBy("company").orderBy("ord")
    return links.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")
