"""Reading figures, claims and documents; writing results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIGURES = "year int, metric string, value double, unit string, scope string, source string, page int"
CLAIMS = "sentence string, page int, section_path string, claim_type string, strength string, quantity string, baseline string, deadline string, scope string, slot_fill_score double, source_file string, negated string, conditional string"


def company_of(path: Column | None = None):
    """The company from a file's name: what stands before the last point."""
    return F.regexp_extract(F.input_file_name() if path is None else path, r"([^/]+)\.[^./]+$", 1)


def read_figures(spark: SparkSession, path: str) -> DataFrame:
    """Figures of all companies under ``path`` ({company}.csv), with company and ord, the row's place.

    ord grows along each file: files are not split within a quoted field, and
    a file's rows keep their order in the ids that Spark gives.
    """
    rows = spark.read.schema(FIGURES).option("header", True).option("escape", '"').csv(path)
    return rows.withColumn("company", company_of()).withColumn("ord", F.monotonically_increasing_id())


def read_claims(spark: SparkSession, path: str) -> DataFrame:
    """Claims; empty fields are null; negated and conditional are booleans (only "true", in any case, is true)."""
    rows = spark.read.schema(CLAIMS).option("header", True).option("escape", '"').csv(path)
    said = lambda c: F.coalesce(F.lower(F.trim(c)) == "true", F.lit(False))
    return rows.withColumns({c: said(F.col(c)) for c in ("negated", "conditional")}).withColumn("file", F.input_file_name()).withColumn("ord", F.monotonically_increasing_id())


#: Besides those of claims: what a file of claim features has.
FEATURES = "company string, publish_year int, report_assured string, n_words int, vague_ratio double, hedging_ratio double, future_ratio double, quantification_present string, baseline_present string, date_present string, scope_present string, verification_present string, sentiment double, specificity_score double, readability double, passive_voice string, modal_firm string, modal_soft string, positive_tone_words int, highlights_json string"
FLAGS = ("negated", "conditional", "report_assured", "quantification_present", "baseline_present", "date_present", "scope_present", "verification_present", "passive_voice", "modal_firm", "modal_soft")


def read_features(spark: SparkSession, path: str, flat: bool = False) -> DataFrame:
    """Claims with their features, columns by name; flags are booleans and highlights an array.  ``flat``: every column as the text it is."""
    schema = T.StructType.fromDDL(f"{CLAIMS}, {FEATURES}")
    # columns are found by the file's header, in whatever order it has them
    rows = spark.read.option("header", True).option("escape", '"').csv(path)
    text = rows.select(*(F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None).cast("string").alias(f.name) for f in schema.fields))
    if flat:
        return text
    typed = text.select(*(said_yes(F.col(f.name)).alias(f.name) if f.name in FLAGS else F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields))
    return typed.withColumn("highlights", parsed_highlights(F.col("highlights_json"))).drop("highlights_json").withColumn("ord", F.monotonically_increasing_id())


HIGHLIGHTS = "array<struct<start:int,end:int,kind:string,term:string>>"


def parsed_highlights(c: Column) -> Column:
    """Highlights from their JSON text; none where it can't be read."""
    return F.coalesce(F.from_json(c, HIGHLIGHTS, {"mode": "PERMISSIVE"}), F.array().cast(HIGHLIGHTS))


def json_text(c: Column) -> Column:
    return F.to_json(c)


def said_yes(c) -> Column:
    """The wider rule for truth in text columns: true, 1 or yes."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "1", "yes"), F.lit(False))


def read_optional_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A JSON document, or an empty table of its schema if there is no such file."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).json(path, multiLine=True)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


#: A report is no larger than this.
MOST_BYTES = 50 * 1024 * 1024


def report_files(spark: SparkSession, path: str, last: int | None = None) -> DataFrame:
    """path, company, publish_year, length, is_pdf and fits (at most ``MOST_BYTES``) of each report {company}/{year}_*; of each company the last n."""
    from pyspark.sql import Window

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    out = files.select(
        "path",
        F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("company"),
        F.regexp_extract("path", r"/([0-9]{4})(?:_[^/]*)?$", 1).try_cast("int").alias("publish_year"),
        "length",
        F.col("length").between(1, MOST_BYTES).alias("fits"),
        (F.hex(F.substring("content", 1, 4)) == "25504446").alias("is_pdf"),
    )
    if last is None:
        return out
    order = Window.partitionBy("company").orderBy(F.col("path").desc())
    return out.withColumn("n", F.row_number().over(order)).where(F.col("n") <= last).drop("n")


def validated_requests(requests: DataFrame, newest: int, most: int = 8) -> DataFrame:
    """Requests to add reports (reports: array of (year, url, file)) with ``error``: null if all is well."""
    r = F.col("reports")
    bad = lambda test: F.exists(r, test)
    error = (
        F.when(r.isNull() | (F.size(r) == 0), "no reports")
        .when(F.size(r) > most, f"more than {most} reports")
        .when(bad(lambda x: F.coalesce(x["year"] < 2000, F.lit(True)) | (x["year"] > newest + 1)), "year out of range")
        .when(bad(lambda x: (x["url"].isNull() | (x["url"] == "")) == (x["file"].isNull() | (x["file"] == ""))), "exactly one of url and file is needed")
        .when(bad(lambda x: F.coalesce(x["url"] != "", F.lit(False)) & ~x["url"].rlike("(?i)^https?://")), "only http and https")
    )
    return requests.withColumn("error", error)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("escape", '"').mode("overwrite").csv(path)


def write_documents(df: DataFrame, path: str, by: str = "company") -> None:
    """One JSON line for each row, in a folder for each company; nested columns stay nested; nulls are written."""
    df.write.option("ignoreNullFields", False).partitionBy(by).mode("overwrite").json(path)


def schema_json(df: DataFrame) -> str:
    return df.schema.json()


def write_features(df: DataFrame, path: str, by: str = "company") -> None:
    """Claim features as CSV, in a folder for each company; highlights as JSON text."""
    nested = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))]
    df.withColumns({c: json_text(F.col(c)) for c in nested}).write.option("header", True).option("escape", '"').partitionBy(by).mode("overwrite").csv(path)


def write_drafts(drafts: DataFrame, path: str) -> None:
    """Figures found, and rejected candidates with the reason: two tables under ``path``, from one table with status."""
    write_csv(drafts.where("status = 'ok'").drop("reason").sortWithinPartitions("metric", "year", "doc"), f"{path}/drafts")
    lines = drafts.where("status = 'rejected'").select(F.concat(F.col("doc").cast("string"), F.lit(" p"), F.col("page").cast("string"), F.lit(": "), F.col("metric"), F.lit(": "), F.col("reason"), F.lit(" | "), F.coalesce("quote", F.lit(""))).alias("value"))
    lines.write.mode("overwrite").text(f"{path}/rejected")


def write_bundle(documents: DataFrame, path: str, name: str = "DOCUMENTS") -> None:
    """Documents as a script that a page can load from disk: a line for each company."""
    own = F.struct(*(c for c in documents.columns if c != "company"))
    line = F.concat(F.lit(f"(window.{name} = window.{name} || {{}})["), F.to_json(F.array("company")), F.lit("] = "), F.to_json(own, {"ignoreNullFields": "false"}), F.lit(";"))
    documents.select(line.alias("value")).write.mode("overwrite").text(path)
