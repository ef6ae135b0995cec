"""Sinks, readers, the stream and what the assembled document is made of."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import matching, scoring, tables
from tidemark.operators.common import checkpointed, shared_dir
from tidemark.sources import figures as sources
from tidemark.streaming.revisions import revisions


def test_features_go_out_and_come_back(spark, tmp_path):
    rows = [("We will, \"surely\", cut", 3, "h1 > h2", "target", True, 0.25, "c", 2021, [(0, 2, "vague", "We")]), (None, None, None, "other", False, None, "d", 2020, [])]
    df = spark.createDataFrame(rows, f"sentence string, page int, section_path string, claim_type string, negated boolean, specificity_score double, company string, publish_year int, highlights {sources.HIGHLIGHTS}").withColumnRenamed("highlights", "highlights_json")
    sources.write_features(df, f"{tmp_path}/features")
    assert sorted(p.name for p in (tmp_path / "features").glob("company=*")) == ["company=c", "company=d"]
    got = {r.company: r for r in sources.read_features(spark, f"{tmp_path}/features").collect()}
    assert got["c"].sentence == rows[0][0] and got["c"].negated is True and got["c"].page == 3 and got["c"].highlights[0].term == "We"
    assert got["d"].negated is False and got["d"].specificity_score is None and got["d"].highlights == [] and got["d"].report_assured is False
    flat = sources.read_features(spark, f"{tmp_path}/features", flat=True)
    assert {t for _, t in flat.drop("company", "publish_year").dtypes} == {"string"}


def test_drafts_go_to_two_tables_and_documents_to_a_script(spark, tmp_path):
    drafts = spark.createDataFrame([("d", 1, "Scope 1", 2020, "ok", None, "q"), ("d", 2, "Scope 2", None, "rejected", "no fitting unit", "Scope 2 row")], "doc string, page int, metric string, year int, status string, reason string, quote string")
    sources.write_drafts(drafts, f"{tmp_path}/out")
    assert spark.read.option("header", True).csv(f"{tmp_path}/out/drafts").count() == 1
    assert [r.value for r in spark.read.text(f"{tmp_path}/out/rejected").collect()] == ["d p2: Scope 2: no fitting unit | Scope 2 row"]
    docs = spark.createDataFrame([("a", 1.5, [1, 2]), ("b", None, [])], "company string, score double, years array<int>")
    sources.write_bundle(docs, f"{tmp_path}/bundle")
    lines = sorted(r.value for r in spark.read.text(f"{tmp_path}/bundle").collect())
    assert len(lines) == 2 and lines[0].startswith('(window.DOCUMENTS = window.DOCUMENTS || {})[["a"]] = ')
    assert json.loads(lines[1].split(" = ", 2)[2].rstrip(";")) == {"score": None, "years": []}
    assert json.loads(sources.schema_json(docs))["fields"][0]["name"] == "company"
    sources.write_documents(docs, f"{tmp_path}/json")
    assert spark.read.json(f"{tmp_path}/json").count() == 2
    sources.write_csv(docs.drop("years"), f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == 2


def test_kinds_of_events_keep_their_order(spark):
    rows = [("c", kind, 2000, 1, 1) for kind in reversed(matching.PRIORITY)] + [("c", "deadline_dropped", 1999, 5, 5), ("d", "specificity_fell", 1, 1, 1)]
    df = spark.createDataFrame(rows, "company string, type string, from_year int, i int, j int")
    got = [(r.type, r.from_year) for r in matching.by_priority(df).where("company = 'c'").orderBy("rank").collect()]
    assert [k for k, _ in got][:5] == ["commitment_softened", "achievement_reverted_to_aspiration", "commitment_negated", "deadline_dropped", "deadline_dropped"] and got[3][1] == 1999
    assert matching.by_priority(df, 2).count() == 3


def test_a_label_may_run_over_rows(spark):
    rows = [("d", 1, 0, "Total scope"), ("d", 1, 1, "1 emissions"), ("d", 1, 2, "2020 2021 2022"), ("d", 2, 0, "Total scope"), ("d", 2, 1, "2020 2021 2022"), ("d", 3, 0, "scope 1"), ("d", 3, 1, "2020 2021")]
    df = spark.createDataFrame(rows, "doc string, page int, row int, text string")
    assert [tuple(r) for r in tables.candidate_pages(df).collect()] == [("d", 1)]


def test_a_companys_own_metric(spark):
    assert tables.metrics_for("other") == tables.METRICS and tables.metrics_for("hm")[-1][0] == "Recycled materials share"
    words = [("d", 1, x * 30.0, x * 30.0 + 20, top, w) for top, line in ((0.0, "Share 2022 2021 2020"), (10.0, "Recycled materials (%) 30% 20% 10%")) for x, w in enumerate(line.split())]
    rows = tables.word_rows(spark.createDataFrame(words, "doc string, page int, x0 double, x1 double, top double, text string"))
    got = [(r.metric, r.year, r.value, r.unit) for r in tables.draft(rows, tables.metrics_for("hm")).where("status = 'ok'").orderBy(F.desc("year")).collect()]
    assert got == [("Recycled materials share", 2022, "30", "%"), ("Recycled materials share", 2021, "20", "%"), ("Recycled materials share", 2020, "10", "%")]
    assert tables.draft(rows, tables.METRICS).count() == 0


@pytest.mark.parametrize("batch", [2, 10_000])
def test_revisions_are_in_the_order_of_publication_across_batches(spark, tmp_path, batch):
    """Publish years in any order, several rows a year, over many Arrow batches; a late report changes nothing."""
    def feed(name, rows):
        spark.createDataFrame(rows, "company string, year int, metric string, value double, pub int, ord long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")

    def events(name):
        stream = spark.readStream.schema("company string, year int, metric string, value double, pub int, ord long").parquet(f"{tmp_path}/{name}")
        q = revisions(stream).writeStream.format("parquet").option("path", f"{tmp_path}/{name}-out").option("checkpointLocation", f"{tmp_path}/{name}-at").trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((r.old_pub, r.new_pub, r.old, r.new) for r in spark.read.parquet(f"{tmp_path}/{name}-out").collect())

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        first = [("c", 2000, "m", v, p, o) for o, (v, p) in enumerate([(5.0, 2005), (6.0, 2006), (3.0, 2003), (99.0, 2004), (4.0, 2004), (5.01, 2005)])]
        feed("s", first)
        assert events("s") == [(2003, 2004, 3.0, 4.0), (2004, 2005, 4.0, 5.01), (2005, 2006, 5.01, 6.0)]
        feed("s", [("c", 2000, "m", 1.0, 2001, 0), ("c", 2000, "m", 0.0, 2007, 1), ("c", 2000, "m", 2.0, 2008, 2)])
        assert events("s")[3:] == [(2006, 2007, 6.0, 0.0), (2007, 2008, 0.0, 2.0)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_tables_that_cut_lineage_lie_in_the_shared_folder(spark):
    df = spark.range(10).withColumn("x", F.rand(3))
    out = checkpointed(df)
    assert out.schema.names == df.schema.names and shared_dir(spark) + "/" in out.inputFiles()[0]


def test_scores_of_the_newest_report(spark):
    rows = [("a", 2020, "target", 0.9, True, False), ("a", 2021, "target", 0.5, True, False), ("a", 2021, "other", 0.0, True, False), ("a", 2021, "achievement", None, True, True), ("b", 2021, "other", 0.3, True, False)]
    f = spark.createDataFrame(rows, "company string, publish_year int, claim_type string, specificity_score double, quantification_present boolean, verification_present boolean")
    a = spark.createDataFrame([("a", 2021, True, "limited")], "company string, publish_year int, assured boolean, level string")
    got = {r.company: (r.n_material, r.vagueness, r.unsupported_claims) for r in scoring.language_scores(f, a).collect()}
    assert got == {"a": (2, 75.0, 45.0), "b": (0, 70.0, None)}
