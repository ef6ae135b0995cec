"""Figures out of tables on report pages, from words and where they stand.

Words have doc, page, x0, x1, top and text.  Rows are put together by height;
a metric's label, the numbers after it, the years of the header above and the
unit make figures, and what can't be tied without guessing is rejected with
the reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

ROW_HEIGHT, COLUMN_GAP, LOOK_BACK = 2.5, 18.0, 20
# ---- fixed patterns
HEADER_TOKEN = r"^\(?(?:FY\s?)?((?:19|20)\d{2})\)?,?$"
NUMBER_TOKEN = r"^[-–−]?\(?\d[\d,]*\.?\d*\)?%?$"
BARE_YEAR, YEAR_AND_NOTE = r"^\(?(?:19|20)\d{2}\)?,?$", r"^(?:19|20)\d{2}\d{1,2}$"
ANY_YEAR = r"(?:FY\s?)?((?:19|20)\d{2})(?!,)"
YEAR_IN_CONTEXT = r"(?iu)(?:in|for|during|since)\s+(?:FY\s?)?((?:19|20)\d{2})"
COMBINED = r"(?iu)scope\s*1\s*(?:and|&)\s*(?:scope\s*)?2"
WITHOUT_USE = r"(?iu)excl(?:uding|\.)?\s*(?:the\s*)?use[\s\-]?(?:of\s*sold\s*products|phase)"
UNITS = (
    (r"MMT\s*CO\s*₂?\s*e", "MMT CO2e (million metric tons CO2e)"),
    (r"MTCO\s*₂?\s*e", "MTCO2e (thousand metric tons CO2e)"),
    (r"metric tons?\s*(?:of\s*)?CO\s*₂?\s*e", "metric tons CO2e"),
    (r"tonnes?\s*CO\s*₂?\s*e", "tonnes CO2e"),
    (r"\btonnes?\s*COe\b", "tonnes CO2e (subscript '2' dropped by PDF text extraction)"),
    (r"tCO\s*₂?\s*e", "tCO2e"),
    (r"\btCOe\b", "tCO2e (subscript '2' dropped by PDF text extraction)"),
    (r"\bgallons?\b", "gallons"),
    (r"\bMWh\b", "MWh"),
    (r"%", "%"),
)
QUALIFIERS = ((r"market[\s\-–−]?based", "market-based"), (r"location[\s\-–−]?based", "location-based"), (r"own operations", "own operations"), (r"gross\b", "gross"))
METRICS = (
    ("Scope 1", r"\bscope\s*1\b(?!\s*(?:and|&)\s*2)"),
    ("Scope 2", r"\bscope\s*2\b"),
    ("Scope 3", r"\bscope\s*3\b"),
    ("Renewable electricity share", r"share of renewable electricity|renewable electricity share|renewable electricity in own operations"),
)
#: A company's own metric, besides those above.
COMPANY_METRICS = {
    "hm": ("Recycled materials share", r"share of recycled materials?|recycled materials?\s*\(%\)"),
    "microsoft": ("Carbon removal contracted", r"carbon removal (?:credits?|contracted)|tons? of carbon removal"),
    "delta": ("SAF volume", r"sustainable aviation fuel|\bSAF\b"),
}
PERCENTAGES = ("Renewable electricity share", "Recycled materials share")
EMISSIONS = ("Scope 1", "Scope 2 market-based", "Scope 2 location-based", "Scope 3 total (excl. use-phase)", "Scope 3 total (incl. use-phase)", "Carbon removal contracted")


def metrics_for(company: str) -> tuple[tuple[str, str], ...]:
    """The metrics to look for in a company's reports."""
    return (*METRICS, COMPANY_METRICS[company]) if company in COMPANY_METRICS else METRICS


def word_rows(words: DataFrame) -> DataFrame:
    """doc, page, row (its order on the page), words (left to right) and text."""
    key = F.bround(F.col("top") / ROW_HEIGHT, 0)
    out = words.groupBy("doc", "page", key.alias("_key")).agg(F.sort_array(F.collect_list(F.struct("x0", "x1", "text"))).alias("words"))
    out = out.withColumn("row", F.row_number().over(Window.partitionBy("doc", "page").orderBy("_key")) - 1).drop("_key")
    return out.withColumn("text", F.array_join(F.transform("words", lambda w: w["text"]), " "))


def header_years(text: Column) -> Column:
    """The first run of two or more year tokens in a row: an array of texts; null if none.  A fold over the tokens."""
    year = lambda t: F.regexp_extract(t, HEADER_TOKEN, 1)
    start = F.struct(F.array().cast("array<string>").alias("run"), F.lit(False).alias("done"))

    def step(a: Column, t: Column) -> Column:
        grown = F.struct(F.concat(a["run"], F.array(year(t))).alias("run"), a["done"].alias("done"))
        ended = F.struct(F.when(F.size(a["run"]) >= 2, a["run"]).otherwise(F.array().cast("array<string>")).alias("run"), (F.size(a["run"]) >= 2).alias("done"))
        return F.when(a["done"], a).when(year(t) != "", grown).otherwise(ended)

    run = F.aggregate(F.split(text, r"\s+", -1), start, step)["run"]
    return F.get(F.filter(F.array(run), lambda r: F.size(r) >= 2), F.lit(0))


def unit_of(text: Column) -> Column:
    return F.coalesce(*(F.when(text.rlike("(?iu)" + p), label) for p, label in UNITS))


def qualifiers_of(text: Column) -> Column:
    return F.array_compact(F.array(*(F.when(text.rlike("(?iu)" + p), label) for p, label in QUALIFIERS)))


def unit_fits(metric: Column, unit: Column) -> Column:
    fits = F.when(metric.isin(*EMISSIONS), F.contains(unit, F.lit("CO")) | F.contains(F.lower(unit), F.lit("ton"))).when(metric.isin(*PERCENTAGES), unit == "%").otherwise(unit != "%")
    return F.coalesce(fits, F.lit(False))


def clean_value(token: Column) -> Column:
    digits = F.regexp_replace(token, r"[^\d.]", "")
    negative = token.rlike(r"^[-–−]") | token.rlike(r"^\(.*\)$")
    return F.when(digits == "", token).when(negative, F.concat(F.lit("-"), digits)).otherwise(digits)


def is_value(token: Column) -> Column:
    return token.rlike(NUMBER_TOKEN) & ~token.rlike(BARE_YEAR) & ~token.rlike(YEAR_AND_NOTE)


def numeric_run(words: Column, start: Column) -> Column:
    """struct(values, last, ...): value tokens from word ``start`` (from 0) on, up to where, after a value, a wide gap leads to a word.

    A fold over the words; last is the place of the last word taken.
    """
    rest = F.slice(words, start + 1, F.greatest(F.lit(0), F.size(words) - start))
    seed = F.struct(F.array().cast("array<string>").alias("values"), (start - 1).alias("last"), F.lit(None).cast("double").alias("x1"), F.lit(False).alias("done"))

    def step(a: Column, w: Column) -> Column:
        value, gap = is_value(w["text"]), F.coalesce(w["x0"] - a["x1"], F.lit(0.0))
        stop = ~value & (gap > COLUMN_GAP) & (F.size(a["values"]) > 0)
        values = F.when(value, F.concat(a["values"], F.array(w["text"]))).otherwise(a["values"])
        go = F.struct(values.alias("values"), (a["last"] + 1).alias("last"), w["x1"].cast("double").alias("x1"), F.lit(False).alias("done"))
        ended = F.struct(a["values"].alias("values"), a["last"].alias("last"), a["x1"].alias("x1"), F.lit(True).alias("done"))
        return F.when(a["done"], a).when(stop, ended).otherwise(go)

    return F.aggregate(rest, seed, step)


def consistency(values: Column, years: Column, extra: Column) -> Column:
    """pass, fail or not_available: whether the first columns after the years agree, as changes in percent, with the values."""
    number = lambda t: clean_value(t).try_cast("double")
    v = F.transform(F.slice(values, 1, F.size(years)), number)
    c = F.transform(F.slice(extra, 1, 2), number)
    off = lambda expected, said: F.abs(expected - said) > F.greatest(F.lit(0.5), 0.1 * F.abs(said))
    first, second, last = F.get(v, F.lit(0)), F.get(v, F.lit(1)), F.element_at(v, -1)
    unclear = (F.size(extra) == 0) | (F.size(years) < 2) | F.exists(v, lambda x: x.isNull()) | F.exists(c, lambda x: x.isNull()) | (second == 0)
    bad = off((first - second) / second * 100, F.get(c, F.lit(0))) | ((F.size(c) >= 2) & (last != 0) & off((first - last) / last * 100, F.get(c, F.lit(1))))
    return F.when(unclear, "not_available").when(F.coalesce(bad, F.lit(False)), "fail").otherwise("pass")


def candidate_pages(rows: DataFrame, metrics: tuple[tuple[str, str], ...] = METRICS, most: int = 5) -> DataFrame:
    """doc, page of pages with a metric's label and a header of three or more years; of each document the first ones.

    The label may run over rows: it is looked for in the page's text as a whole.
    """
    lines = F.transform(F.sort_array(F.collect_list(F.struct("row", "text"))), lambda r: r["text"])
    pages = rows.groupBy("doc", "page").agg(F.array_join(lines, " ").alias("whole"), F.max(F.coalesce(F.size(header_years(F.col("text"))), F.lit(0))).alias("n"))
    label = F.lit(False)
    for _, p in metrics:
        label = label | F.col("whole").rlike("(?iu)" + p)
    pages = pages.where(label & (F.col("n") >= 3))
    order = Window.partitionBy("doc").orderBy("page")
    return pages.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).select("doc", "page")


def in_order(drafts: DataFrame) -> DataFrame:
    """Figures found, with rank: their place within the document by metric, year and page."""
    order = Window.partitionBy("doc").orderBy("metric", F.col("year").cast("string"), "page", "row")
    return drafts.where("status = 'ok'").withColumn("rank", F.row_number().over(order))


def draft(rows: DataFrame, metrics: tuple[tuple[str, str], ...] = METRICS) -> DataFrame:
    """Every row with a metric's label: a row for each figure (status ok), or one with the reason why there is none.

    Columns: doc, page, row, metric, status, reason, branch, year, value, unit,
    scope, quote, header, consistency_check, confidence.
    """
    before = Window.partitionBy("doc", "page").orderBy("row").rowsBetween(-LOOK_BACK, -1)
    years, unit = F.col("_header"), F.col("_unit")
    rows = checkpointed(rows.withColumn("_header", header_years(F.col("text"))).withColumn("_unit", unit_of(F.col("text"))))
    seen = rows.withColumn("above", F.last(F.when(years.isNotNull(), F.struct(years.alias("years"), F.col("text").alias("text"))), True).over(before)).withColumn("unit_above", F.last(F.when(unit.isNotNull(), F.struct(unit.alias("unit"), F.col("text").alias("text"))), True).over(before))
    labels = F.array_compact(F.array(*(F.when(F.col("text").rlike("(?iu)" + p), F.struct(F.lit(m).alias("base"), (F.regexp_instr("text", F.lit("(?iu)" + p)) - 1 + F.length(F.regexp_extract("text", "(?iu)" + p, 0))).alias("end"))) for m, p in metrics)))
    t = seen.where((F.col("text") != "") & ~F.col("text").rlike(COMBINED)).withColumn("label", F.explode(labels))
    # the word in which the label ends
    none = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"))
    pass_ = lambda a, w: F.struct((a["at"] + F.length(w["text"]) + 1).alias("at"), (a["n"] + (a["at"] + F.length(w["text"]) < F.col("label.end")).cast("int")).alias("n"))
    t = t.withColumn("_start", F.aggregate("words", none, pass_)["n"] + 1)
    t = checkpointed(t.withColumn("run", numeric_run(F.col("words"), F.col("_start"))))
    quote = F.when(F.size("run.values") > 0, F.array_join(F.transform(F.slice("words", F.lit(1), F.col("run.last") + 1), lambda w: w["text"]), " ")).otherwise(F.col("text"))
    t = t.withColumn("quote", quote).withColumn("own_unit", unit_of(F.col("quote"))).withColumn("qualifiers", qualifiers_of(F.col("quote")))
    base, q, values = F.col("label.base"), F.col("qualifiers"), F.col("run.values")
    metric = (
        F.when(base == "Scope 2", F.when(F.array_contains(q, "market-based"), "Scope 2 market-based").when(F.array_contains(q, "location-based"), "Scope 2 location-based"))
        .when(base == "Scope 3", F.when(F.col("quote").rlike(WITHOUT_USE), "Scope 3 total (excl. use-phase)").otherwise("Scope 3 total (incl. use-phase)"))
        .otherwise(base)
    )
    t = t.withColumn("metric", metric).withColumn("inline", F.regexp_extract_all("quote", F.lit(ANY_YEAR), 1)).withColumn("context", F.regexp_extract("quote", YEAR_IN_CONTEXT, 1))
    n = F.size(values)
    branch = F.when(F.col("metric").isNull(), "no basis").when((F.col("context") != "") & (n >= 1), "context").when((F.size(F.array_distinct("inline")) == 1) & (n == 1), "single").when((F.size("inline") == 0) & (n > 0), "table").otherwise("ambiguous")
    t = t.withColumn("branch", branch).withColumn("borrowed", (F.col("branch") == "table") & F.col("own_unit").isNull() & F.col("unit_above").isNotNull())
    t = t.withColumn("unit", F.when(F.col("branch") == "table", F.coalesce("own_unit", "unit_above.unit")).otherwise(F.col("own_unit")))
    reason = (
        F.when(F.col("branch") == "no basis", "basis not stated in the row")
        .when(F.col("branch") == "ambiguous", "no year could be tied to a value")
        .when(~unit_fits(F.col("metric"), F.col("unit")), "no fitting unit")
        .when((F.col("branch") == "table") & F.col("above").isNull(), "no header of years above")
        .when((F.col("branch") == "table") & (n < F.size("above.years")), "fewer values than years")
    )
    t = t.withColumn("reason", reason).withColumn("_years", F.when(F.col("reason").isNotNull(), F.array(F.lit(None).cast("string"))).when(F.col("branch") == "context", F.array("context")).when(F.col("branch") == "single", F.slice("inline", 1, 1)).otherwise(F.col("above.years")))
    t = t.withColumn("_extra", F.slice(values, F.size("_years") + 1, F.greatest(F.lit(0), n - F.size("_years"))))
    t = t.withColumn("_check", F.when(F.col("reason").isNull() & (F.col("branch") == "table"), consistency(values, F.col("_years"), F.col("_extra"))).otherwise("not_available"))
    assumed = (base == "Scope 3") & (F.col("metric") == "Scope 3 total (incl. use-phase)")
    sure = F.when(assumed | F.col("borrowed"), "low").when(F.col("branch") != "table", "high").when((F.col("_check") == "fail") | (n != F.size("_years")), "low").otherwise("medium")
    t = t.withColumn("confidence", F.when(F.col("reason").isNull(), sure)).select("*", F.posexplode("_years").alias("_k", "year"))
    scope = F.when(F.size("qualifiers") > 0, F.array_join("qualifiers", ", ")).otherwise("unspecified basis")
    return t.select(
        "doc", "page", "row", F.coalesce("metric", base).alias("metric"), F.when(F.col("reason").isNull(), "ok").otherwise("rejected").alias("status"), "reason", "branch", F.col("year").try_cast("int").alias("year"),
        F.when(F.col("reason").isNull(), clean_value(F.get(values, F.col("_k")))).alias("value"), F.when(F.col("reason").isNull(), F.col("unit")).alias("unit"), scope.alias("scope"), "quote",
        F.when(F.col("branch") == "table", F.col("above.text")).alias("header"), F.when(F.col("_k") == 0, F.col("_check")).otherwise("not_available").alias("consistency_check"), "confidence",
    )
