"""Figures published again: restated values, redefined metrics, moved targets, and the score of all these.

Figures have company, year, metric, value, unit, scope, source, page and ord
(the row's place in its file, which decides between equals).  One job covers
all companies; every window and aggregate is keyed by company and more, so
partitions stay small and combine before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicon import Settings
from ..functions.numbers import fixed, plain_number, py_round

TARGET = "target_"
EVENT = ("company", "year", "type", "canonical_metric", "old", "new", "magnitude_pct", "weakened", "old_source", "new_source", "page", "description")


def publish_year(source: Column) -> Column:
    """The four digits that begin the file's name, up to its end or an underscore; else null."""
    name = F.element_at(F.split(source, "/", -1), -1)
    return F.regexp_extract(name, r"^([0-9]{4})(?:_|$)", 1).try_cast("int")


def with_publish_year(figures: DataFrame) -> DataFrame:
    return figures if "pub" in figures.columns else figures.withColumn("pub", publish_year(F.col("source")))


def is_target(metric: Column) -> Column:
    return F.startswith(metric, F.lit(TARGET))


def _file(source: Column) -> Column:
    return F.element_at(F.split(source, "/", -1), -1)


def _percent(old: Column, new: Column) -> Column:
    return F.when(old != 0, (new - old) / F.abs(old) * 100)


def _signed(pct: Column) -> Column:
    return F.when(pct.isNull(), "").otherwise(F.concat(F.lit(" ("), fixed(pct, 1, plus=True), F.lit("%)")))


def _republished(figures: DataFrame) -> DataFrame:
    """Each figure with the one of the report before, where the value changed."""
    cell = Window.partitionBy("company", "year", "metric")
    order = cell.orderBy(F.col("pub").asc_nulls_last(), "ord")
    before = F.lag(F.struct("value", "unit", "source")).over(order)
    several = F.min("pub").over(cell) < F.max("pub").over(cell)
    out = with_publish_year(figures).withColumn("before", before).withColumn("several", several)
    return out.where(F.col("before").isNotNull() & (F.col("before.value") != F.col("value"))).withColumn("pct", _percent(F.col("before.value"), F.col("value")))


def restatements(figures: DataFrame, noise_floor_pct: float = Settings.noise_floor_pct) -> DataFrame:
    """A year's figure published by two reports at different values; changes under the noise floor are none; a change from 0 has a null magnitude."""
    out = _republished(figures).where(F.col("several") & (F.col("pct").isNull() | (F.abs("pct") >= noise_floor_pct)))
    old, new = F.col("before.value"), F.col("value")
    text = F.concat(F.format_string("%s for %d was published as ", "metric", "year"), plain_number(old), F.lit(" "), F.coalesce("before.unit", F.lit("")), F.lit(" in "), _file(F.col("before.source")), F.lit(", then restated to "), plain_number(new), F.lit(" "), F.coalesce("unit", F.lit("")), F.lit(" in "), _file(F.col("source")), _signed(F.col("pct")))
    return out.select(
        "company", "year", F.lit("metric_restated").alias("type"), F.col("metric").alias("canonical_metric"), plain_number(old).alias("old"), plain_number(new).alias("new"),
        py_round(F.col("pct"), 2).alias("magnitude_pct"), F.lit(None).cast("boolean").alias("weakened"), F.col("before.source").alias("old_source"), F.col("source").alias("new_source"), "page", text.alias("description"),
    )


def metric_prefix(metric: Column) -> Column:
    return F.regexp_replace(metric, "_[^_]*$", "")


def redefinitions(figures: DataFrame) -> DataFrame:
    """A metric that the next report drops while it adds one of the same prefix."""
    named = with_publish_year(figures).where("pub is not null").groupBy("company", "pub", "metric").agg(F.min_by("source", "ord").alias("source"))
    reports = named.select("company", "pub").distinct()
    steps = reports.withColumn("next", F.lead("pub").over(Window.partitionBy("company").orderBy("pub"))).where("next is not null")
    older = named.join(steps, ["company", "pub"]).select("company", "pub", "next", "metric", "source")
    newer = named.join(steps.withColumnRenamed("pub", "last").withColumnRenamed("next", "pub"), ["company", "pub"]).select("company", F.col("last").alias("pub"), F.col("pub").alias("next"), "metric", "source")
    keys = ["company", "pub", "next", "metric"]
    dropped = older.join(newer.select(*keys), keys, "left_anti").withColumn("prefix", metric_prefix(F.col("metric")))
    added = newer.join(older.select(*keys), keys, "left_anti").withColumn("prefix", metric_prefix(F.col("metric"))).withColumnsRenamed({"metric": "sibling", "source": "sibling_source"})
    both = dropped.join(added, ["company", "pub", "next", "prefix"])
    text = F.format_string("metric '%s' reported through the %d report was replaced by '%s' in the %d report; the two are not directly comparable", "metric", "pub", "sibling", "next")
    null = F.lit(None)
    return both.select(
        "company", F.col("next").alias("year"), F.lit("metric_redefined").alias("type"), F.col("sibling").alias("canonical_metric"), F.col("metric").alias("old"), F.col("sibling").alias("new"),
        null.cast("double").alias("magnitude_pct"), null.cast("boolean").alias("weakened"), F.col("source").alias("old_source"), F.col("sibling_source").alias("new_source"), null.cast("int").alias("page"), text.alias("description"),
    )


def _last_published(targets: DataFrame) -> DataFrame:
    """Each target's last publication, beside the company's newest report."""
    t = with_publish_year(targets).where("pub is not null")
    last = t.groupBy("company", "year", "metric").agg(F.max_by(F.struct("value", "unit", "source"), F.struct("pub", "ord")).alias("last"), F.max("pub").alias("last_pub"), F.min("pub").alias("first_pub"))
    newest = t.groupBy("company").agg(F.max("pub").alias("newest"), F.min_by("source", F.struct(-F.col("pub"), "ord")).alias("newest_source"))
    live = (F.col("last_pub") < F.col("newest")) & (F.col("year") > F.col("last_pub"))
    return last.join(newest, "company").withColumn("gone", live)


def target_drift(targets: DataFrame) -> DataFrame:
    """Targets published again at another level, and targets dropped while their deadline lay ahead."""
    t = with_publish_year(targets).where("pub is not null")
    name = F.regexp_replace("metric", f"^{TARGET}", "")
    old, new = F.col("before.value"), F.col("value")
    weaker = new < old
    text = F.concat(F.format_string("the %d target for %s was published as ", F.col("year"), name), plain_number(old), F.coalesce("before.unit", F.lit("")), F.lit(" in "), _file(F.col("before.source")), F.when(weaker, ", then cut to ").otherwise(", then raised to "), plain_number(new), F.coalesce("unit", F.lit("")), F.lit(" in "), _file(F.col("source")), _signed(F.col("pct")))
    changed = _republished(t).select(
        "company", "year", F.lit("target_value_changed").alias("type"), F.col("metric").alias("canonical_metric"), plain_number(old).alias("old"), plain_number(new).alias("new"),
        py_round(F.col("pct"), 2).alias("magnitude_pct"), weaker.alias("weakened"), F.col("before.source").alias("old_source"), F.col("source").alias("new_source"), "page", text.alias("description"),
    )
    value = plain_number(F.col("last.value"))
    text = F.concat(F.format_string("the %d target for %s (", F.col("year"), name), value, F.coalesce("last.unit", F.lit("")), F.lit(") was last published in "), _file(F.col("last.source")), F.format_string(" and no longer appears as of the %d report, with its deadline still in the future", "newest"))
    dropped = _last_published(t).where("gone").select(
        "company", "year", F.lit("commitment_dropped").alias("type"), F.col("metric").alias("canonical_metric"), value.alias("old"), F.lit(None).cast("string").alias("new"),
        F.lit(-100.0).alias("magnitude_pct"), F.lit(True).alias("weakened"), F.col("last.source").alias("old_source"), F.col("newest_source").alias("new_source"), F.lit(None).cast("int").alias("page"), text.alias("description"),
    )
    return changed.unionByName(dropped)


def drift_events(figures: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """All kinds of events, numbered within each company in the order of year, type and metric."""
    actuals, targets = figures.where(~is_target(F.col("metric"))), figures.where(is_target(F.col("metric")))
    events = restatements(actuals, settings.noise_floor_pct).unionByName(redefinitions(actuals)).unionByName(target_drift(targets))
    order = Window.partitionBy("company").orderBy("year", "type", F.coalesce("canonical_metric", F.lit("")), "old_source", "new_source", "old", "new")
    return events.withColumn("drift_id", F.format_string("%s-drift-%03d", "company", F.row_number().over(order) - 1))


def comparable_pairs(figures: DataFrame) -> DataFrame:
    """company, comparable_pairs: cells (year, metric) published by several reports."""
    cells = with_publish_year(figures).groupBy("company", "year", "metric").agg((F.min("pub") < F.max("pub")).alias("again"))
    return cells.groupBy("company").agg(F.count_if("again").alias("comparable_pairs"))


def comparable_targets(targets: DataFrame) -> DataFrame:
    """company, comparable_targets: targets published by several reports, or dropped while live."""
    cells = _last_published(targets)
    return cells.groupBy("company").agg(F.count_if((F.col("first_pub") < F.col("last_pub")) | F.col("gone")).alias("comparable_targets"))


def drift_score(events: DataFrame, counts: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """A row for each company of ``counts`` (company, comparable_pairs, comparable_targets): the score and what it rests on.

    Two blocks, of restated figures and of weakened targets, each only where
    something is comparable; the score is null, not 0, where neither is.
    """
    s, kind, size = settings, F.col("type"), F.abs("magnitude_pct")
    weaker = (kind == "commitment_dropped") | ((kind == "target_value_changed") & F.col("weakened"))
    facts = events.groupBy("company").agg(
        F.count_if(kind == "metric_restated").alias("restated"),
        F.count_if(kind == "metric_redefined").alias("redefined"),
        F.median(F.when(kind == "metric_restated", size)).alias("median_pct"),
        F.max(F.when(kind == "metric_restated", size)).alias("max_pct"),
        F.count_if(weaker).alias("weakened"),
        F.count_if(kind == "commitment_dropped").alias("dropped"),
        F.count_if((kind == "target_value_changed") & ~F.col("weakened")).alias("strengthened"),
        F.median(F.when(weaker, size)).alias("median_cut"),
    )
    none = dict.fromkeys(("restated", "redefined", "weakened", "dropped", "strengthened", "comparable_pairs", "comparable_targets"), 0)
    t = counts.join(facts, "company", "left").fillna(none)
    share = lambda x, most: F.least(F.coalesce(x, F.lit(0.0)) / F.lit(most), F.lit(1.0)) * 100
    rate, cut_rate = F.col("restated") / F.col("comparable_pairs"), F.col("weakened") / F.col("comparable_targets")
    actuals = F.lit(s.rate_weight) * (rate * 100) + F.lit(s.magnitude_weight) * share(F.col("median_pct"), s.magnitude_saturation_pct) + F.lit(s.redefinition_weight) * F.least(F.col("redefined") * 25.0, F.lit(100.0))
    aims = F.lit(s.target_rate_weight) * (cut_rate * 100) + F.lit(s.target_magnitude_weight) * share(F.col("median_cut"), s.target_cut_saturation_pct)
    t = t.withColumn("actuals_component", F.when(F.col("comparable_pairs") > 0, actuals)).withColumn("target_component", F.when(F.col("comparable_targets") > 0, aims))
    parts = [(F.col("actuals_component"), s.actuals_block_weight), (F.col("target_component"), s.targets_block_weight)]
    total = sum((F.coalesce(c * w, F.lit(0.0)) for c, w in parts), F.lit(0.0))
    weight = sum((F.when(c.isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for c, w in parts), F.lit(0.0))
    score = F.when(weight > 0, py_round(F.least(total / weight, F.lit(100.0)), 1))
    rounded = {"actuals_component": py_round(F.col("actuals_component"), 1), "target_component": py_round(F.col("target_component"), 1), "restatement_rate": py_round(F.when(F.col("comparable_pairs") > 0, rate), 3), "target_weakening_rate": py_round(F.when(F.col("comparable_targets") > 0, cut_rate), 3), "median_pct": py_round(F.when(F.col("comparable_pairs") > 0, F.coalesce("median_pct", F.lit(0.0))), 2), "max_pct": py_round(F.when(F.col("comparable_pairs") > 0, F.coalesce("max_pct", F.lit(0.0))), 2), "median_cut": py_round(F.when(F.col("comparable_targets") > 0, F.coalesce("median_cut", F.lit(0.0))), 2)}
    return t.withColumn("goalpost_drift", score).withColumns(rounded)


def drift_by_company(figures: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The whole numeric path: figures to one scored row for each company."""
    actuals, targets = figures.where(~is_target(F.col("metric"))), figures.where(is_target(F.col("metric")))
    companies = figures.select("company").distinct()
    counts = companies.join(comparable_pairs(actuals), "company", "left").join(comparable_targets(targets), "company", "left")
    return drift_score(drift_events(figures, settings), counts, settings)


def latest_series(figures: DataFrame) -> DataFrame:
    """Each metric's rows in the newest report that has the metric."""
    newest = F.max("pub").over(Window.partitionBy("company", "metric"))
    return with_publish_year(figures).withColumn("newest", newest).where(F.col("pub") == F.col("newest")).drop("newest")


def latest_by_year(figures: DataFrame) -> DataFrame:
    """For each metric and year the row of the newest report that has it; of equals, the later row."""
    order = Window.partitionBy("company", "metric", "year").orderBy(F.coalesce("pub", F.lit(0)).desc(), F.col("ord").desc())
    return with_publish_year(figures).withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def emissions_trend(figures: DataFrame) -> DataFrame:
    """company, year, value of metrics that begin total_emissions, in the source that is last by name; of a year's rows, the last."""
    t = figures.where(F.startswith("metric", F.lit("total_emissions")))
    t = t.withColumn("newest", F.max("source").over(Window.partitionBy("company"))).where(F.col("source") == F.col("newest"))
    return t.groupBy("company", "year").agg(F.max_by("value", "ord").alias("value"))


def worsening_years(trend: DataFrame) -> DataFrame:
    """Years whose value is above that of the year just before (a gap is no comparison)."""
    before = trend.select("company", (F.col("year") + 1).alias("year"), F.col("value").alias("before"))
    return trend.join(before, ["company", "year"]).where(F.col("value") > F.col("before")).select("company", "year")


def _intensity(pct: Column, kind: Column, when: Column) -> Column:
    # magnitudes have two digits: a sum in whole hundredths doesn't depend on the order of rows
    moved = F.coalesce(F.sum(F.when(when, F.round(F.abs(pct) * 100).cast("long"))) / 100.0, F.lit(0.0)) + 15.0 * F.count_if(when & (kind == "metric_redefined"))
    return F.when(F.count_if(when) > 0, F.least(moved / 60.0, F.lit(1.0)) * 100)


def yearly_intensity(events: DataFrame, years: DataFrame) -> DataFrame:
    """For each (company, year): how much moved, as known by then and with hindsight; to one digit; null where nothing did."""
    return exact_intensity(events, years).withColumns({c: py_round(F.col(c), 1) for c in ("score_as_of", "score_hindsight")})


def exact_intensity(events: DataFrame, years: DataFrame) -> DataFrame:
    """The same, not rounded: a score that is to have other digits must not be rounded twice."""
    e = events.select("company", "year", "type", "magnitude_pct", publish_year(F.col("new_source")).alias("known"))
    per = e.groupBy("company", "year").agg(_intensity(F.col("magnitude_pct"), F.col("type"), F.coalesce(F.col("known") <= F.col("year"), F.lit(False))).alias("score_as_of"), _intensity(F.col("magnitude_pct"), F.col("type"), F.lit(True)).alias("score_hindsight"))
    return years.select("company", "year").distinct().join(per, ["company", "year"], "left")


def coverage_matrix(figures: DataFrame, years: list[int], row: str = "metric", column: str = "year") -> DataFrame:
    """One row for each metric, a column for each year: - without a value, CONFLICT with several different ones, else OK."""
    n = F.count_distinct("value")
    cell = F.when(n == 0, "-").when(n > 1, "CONFLICT").otherwise("OK")
    return figures.groupBy(row).pivot(column, years).agg(cell).fillna("-")


def unverified(draft: DataFrame, verified: DataFrame) -> DataFrame:
    """Rows of pages that have not been verified."""
    return draft.join(verified.select("source", "page").distinct(), ["source", "page"], "left_anti")


def coverage(figures: DataFrame) -> DataFrame:
    """company, n_reports, n_did_rows, did_years, did_metrics, n_target_rows, target_metrics: what a company's figures cover."""
    target = is_target(F.col("metric"))
    of = lambda when, c: F.sort_array(F.collect_set(F.when(when, F.col(c))))
    return figures.groupBy("company").agg(
        F.count_distinct("source").alias("n_reports"), F.count_if(~target).alias("n_did_rows"), of(~target, "year").alias("did_years"), of(~target, "metric").alias("did_metrics"),
        F.count_if(target).alias("n_target_rows"), of(target, "metric").alias("target_metrics"),
    )
