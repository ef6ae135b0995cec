import random

from pyspark.sql import functions as F

from tidemark.functions.lexicon import Lexicon
from tidemark.functions.slots import with_slots
from tidemark.operators import blocks, facts, features, linkage, matching, rules, scoring, tables
from tidemark.sources import figures as sources

FIGURES = "company string, year int, metric string, value double, unit string, scope string, source string, page int, ord long"


def _figures(spark, rows):
    return spark.createDataFrame([(c, y, m, v, "t", None, f"{c}/{p}_report.pdf", 1, i) for i, (c, y, m, v, p) in enumerate(rows)], FIGURES)


def test_restatements_and_scores(spark):
    f = _figures(spark, [
        ("a", 2019, "total_emissions", 100.0, 2020), ("a", 2019, "total_emissions", 110.0, 2021), ("a", 2018, "x_one", 5.0, 2020), ("a", 2018, "x_one", 5.0, 2021), ("a", 2017, "zero", 0.0, 2020), ("a", 2017, "zero", 3.0, 2021),
        ("a", 2016, "small", 1000.0, 2020), ("a", 2016, "small", 1004.0, 2021), ("a", 2018, "y_old", 1.0, 2020), ("a", 2018, "y_new", 1.0, 2021),
        ("a", 2030, "target_cut", 50.0, 2020), ("a", 2030, "target_cut", 40.0, 2021), ("a", 2040, "target_gone", 9.0, 2020), ("a", 2020, "target_done", 9.0, 2020), ("b", 2019, "m", 1.0, 2020),
    ])
    got = {(r.type, r.canonical_metric): r.magnitude_pct for r in facts.drift_events(f).collect()}
    assert got == {("metric_restated", "total_emissions"): 10.0, ("metric_restated", "zero"): None, ("metric_redefined", "y_new"): None, ("target_value_changed", "target_cut"): -20.0, ("commitment_dropped", "target_gone"): -100.0}
    s = {r.company: r for r in facts.drift_by_company(f).collect()}
    # actuals: 2 of 4 pairs, median 10, one redefinition; targets: 2 of 2 weakened, median cut 60
    actuals, aims = 0.45 * 50 + 0.40 * 10 / 30 * 100 + 0.15 * 25, 0.6 * 100 + 0.4 * 100
    assert s["a"].goalpost_drift == round(0.65 * actuals + 0.35 * aims, 1) and s["b"].goalpost_drift is None
    assert facts.publish_year and [r.y for r in spark.createDataFrame([("a/2020_x.pdf",), ("2021",), ("a/20201_x.pdf",), (None,)], "s string").select(facts.publish_year(F.col("s")).alias("y")).collect()] == [2020, 2021, None, None]


def test_series_intensity_and_gaps(spark):
    f = _figures(spark, [("a", 2018, "total_emissions", 1.0, 2020), ("a", 2018, "total_emissions", 2.0, 2021), ("a", 2017, "total_emissions", 9.0, 2020), ("a", 2020, "total_emissions", 5.0, 2021)])
    assert {(r.year, r.value) for r in facts.latest_series(f).collect()} == {(2018, 2.0), (2020, 5.0)}
    assert {(r.year, r.value) for r in facts.latest_by_year(f).collect()} == {(2017, 9.0), (2018, 2.0), (2020, 5.0)}
    assert facts.worsening_years(facts.emissions_trend(f)).count() == 0
    got = {r.year: (r.score_as_of, r.score_hindsight) for r in facts.yearly_intensity(facts.drift_events(f), f).collect()}
    assert got == {2018: (None, 100.0), 2017: (None, None), 2020: (None, None)}
    row = facts.coverage_matrix(f, [2017, 2018, 2019]).first()
    assert (row["2017"], row["2018"], row["2019"]) == ("OK", "CONFLICT", "-")


def test_a_score_with_no_digits_is_rounded_once(spark):
    # 29.68 of 60 is 49.47 %: 49.5 to one digit, and 50 if that is rounded again
    e = spark.createDataFrame([("a", 2018, "metric_restated", x, "a/2020_r.csv") for x in (9.68, -20.0)], "company string, year int, type string, magnitude_pct double, new_source string")
    years = e.select("company", "year")
    assert facts.yearly_intensity(e, years).first().score_hindsight == 49.5
    assert facts.exact_intensity(e, years).select(F.round("score_hindsight", 0)).first()[0] == 49.0


def test_blocks_to_claims(spark):
    rows, n = [], 0
    for page in range(1, 5):
        for text, size, bold in [("Annual report", 10.0, False), ("Climate goals", 20.0, False) if page == 1 else ("Our energy plan", 10.0, True), (f"We will cut carbon emissions by {page}0% by 2030. We like it here a lot.", 10.0, False), ("tiny note", 5.0, False), ("More text follows here.", 11.0, False)]:
            rows.append(("d", page, n, text, size, bold))
            n += 1
    df = spark.createDataFrame(rows, "doc string, page int, ord int, text string, size double, bold boolean")
    kept = blocks.without_boilerplate(df)
    assert {r.text for r in kept.collect()} & {"Annual report", "tiny note", "More text follows here."} == set()
    claims = {r.page: r for r in blocks.claims(df).collect()}
    assert set(claims) == {1, 2, 3, 4} and claims[1].section_path == "Climate goals" and claims[3].quantity == "30%" and claims[1].claim_type == "target"
    assert {r.outcome: r.n for r in blocks.funnel(blocks.tagged_sentences(df)).collect()} == {"kept": 4, "no candidate": 4}


def _claims(spark, rows):
    df = spark.createDataFrame([(i, c, y, s) for i, (c, y, s) in enumerate(rows)], "id long, company string, publish_year int, sentence string")
    return features.with_features(with_slots(df, Lexicon())).withColumn("ord", F.col("id"))


def test_features_and_series(spark):
    c = _claims(spark, [("a", 2020, "We significantly may improve."), ("a", 2020, "We will cut carbon by 30% by 2030 versus 2019, independently assured."), ("a", 2020, None)])
    r = {x.id: x for x in c.collect()}
    # significantly counts twice
    assert r[0].vague_ratio == 0.5 and r[0].hedging_ratio == 0.25 and r[0].specificity_score == 0.0
    assert r[1].verification_present and r[1].quantification_present and r[1].specificity_score == 0.8 and r[2].n_words == 0 and r[2].readability is None
    s = features.year_series(c).first()
    assert s.n_claims == 3 and s.quantified_share == 0.333 and s.firm_share == 0.333 and s.commitment_ratio == 1.0
    spans = features.with_highlights(c).where("id = 0").first().highlights
    assert [(h.kind, h.term) for h in spans] == [("vague", "significantly"), ("hedge", "may")]
    pages = spark.createDataFrame([("d", 2, "x"), ("d", 3, "KPMG gave limited  assurance over this, unlike reasonable assurance"), ("e", 1, "none")], "doc string, page int, page_text string")
    a = {x.doc: x for x in features.assurance(pages).collect()}
    assert (a["d"].assured, a["d"].page, a["d"].auditor, a["d"].level) == (True, 3, "KPMG", "limited") and not a["e"].assured and a["e"].level is None


def test_matching_and_differences(spark):
    c = _claims(spark, [
        ("a", 2020, "We will cut absolute emissions by 30% by 2030 globally."), ("a", 2022, "We aim to cut absolute emissions by 2035."), ("a", 2020, "We will use renewable energy for 50% of power by 2025."), ("a", 2022, "We will not use renewable energy for 50% of power by 2025."),
    ])
    got = {(r.i, r.type) for r in matching.language_drift(c).collect()}
    assert {(0, "commitment_softened"), (0, "quantity_dropped"), (0, "deadline_pushed"), (0, "scope_narrowed"), (2, "commitment_negated")} <= got
    assert not any(t == "commitment_softened" for i, t in got if i == 2)
    assert matching.language_drift(c.where("publish_year = 2020")).count() == 0


def test_greedy_equals_sorted_taking(spark):
    r, rows, want = random.Random(5), [], set()
    for g in range(40):
        pairs = {(r.randrange(5), r.randrange(5)): r.choice([0.6, 0.7, 0.8]) for _ in range(12)}
        rows += [(g, i, j, s) for (i, j), s in pairs.items()]
        a, b = set(), set()
        for (i, j), _ in sorted(pairs.items(), key=lambda p: (-p[1], p[0])):
            if i not in a and j not in b:
                a.add(i)
                b.add(j)
                want.add((g, i, j))
    out = matching.greedy_matches(spark.createDataFrame(rows, "g int, i int, j int, rank double"), ["g"])
    assert {(x.g, x.i, x.j) for x in out.collect()} == want


def test_rules(spark):
    c = _claims(spark, [("a", 2020, "We significantly improved our certified packaging."), ("a", 2020, "We reduced waste by 30% by 2030."), ("a", 2021, "We reduced waste by 30% by 2030.")])
    worse = spark.createDataFrame([("a", 2021)], "company string, year int")
    t = rules.tagged(c, worse)
    got = {r.id: [x.sin for x in r.sins] for r in t.collect()}
    assert got == {0: ["vagueness", "false_labels"], 1: ["no_proof"], 2: ["no_proof", "hidden_trade_off"]}
    assert rules.sin_scores(c, t).first().n_tagged == 3


def test_say_do(spark):
    f = _figures(spark, [("a", y, m, v, 2023) for y, v in ((2019, 100.0), (2022, 99.0)) for m in ("total_emissions", "scope_3_emissions")])
    c = _claims(spark, [("a", 2020, f"We will cut {p} by 50% by 2030 against a 2019 base year.") for p in ("total emissions", "scope 3 emissions", "our total GHG")] + [("a", 2020, "We will not cut total emissions by 50% by 2030.")])
    links = linkage.say_do_links(c, f)
    assert sorted((r.id, r.metric, r.status) for r in links.collect()) == [(0, "total_emissions", "behind"), (1, "scope_3_emissions", "behind"), (2, "total_emissions", "behind")]
    assert linkage.say_do_score(links, f).first().say_do_gap == 100.0
    assert linkage.say_do_score(links.where("id < 2"), f).first().say_do_gap is None


def test_blend_percentile_and_documents(spark):
    s = spark.createDataFrame([("a", 50.0, 50.0, None, None), ("b", 10.0, 20.0, 30.0, None), ("c", None, None, None, None)], "company string, vagueness double, unsupported_claims double, sins_severity double, goalpost_drift double")
    got = {r.company: r.overall for r in scoring.blended(s).collect()}
    assert got == {"a": None, "b": round((10 * 0.15 + 20 * 0.2 + 30 * 0.25) / 0.6, 1), "c": None}
    p = {r.company: r.peer_percentile for r in scoring.with_percentile(s, "vagueness").collect()}
    assert p == {"a": 100.0, "b": 0.0, "c": None}
    d = {r.company: r.scores for r in scoring.documents(s, scores=s.where("company <> 'c'").select("company", "vagueness")).collect()}
    assert len(d["a"]) == 1 and d["c"] == []
    assert spark.range(1).select(scoring.confidence(F.lit(4), F.lit(5))).first()[0] == "high"


def test_drafts_from_words(spark):
    def row(top, *words):
        return [("d", 1, float(30 * i), float(30 * i + 20), top, w) for i, w in enumerate(words)]

    rows = row(0.0, "Emissions", "(tCO₂e)", "2022", "2021", "2020") + row(10.0, "Scope", "1", "90", "100", "120", "-10", "-25") + row(20.0, "Scope", "2", "5", "6", "7") + row(30.0, "Scope", "3", "8", "9") + row(40.0, "Scope", "1", "and", "2", "4")
    t = tables.draft(tables.word_rows(spark.createDataFrame(rows, "doc string, page int, x0 double, x1 double, top double, text string")))
    got = {(r.metric, r.year): r for r in t.collect()}
    assert [got["Scope 1", y].value for y in (2022, 2021, 2020)] == ["90", "100", "120"] and got["Scope 1", 2022].consistency_check == "pass" and got["Scope 1", 2022].confidence == "low"
    assert got["Scope 2", None].reason == "basis not stated in the row" and got["Scope 3 total (incl. use-phase)", None].reason == "fewer values than years" and len(got) == 5


def test_sources(spark, tmp_path):
    (tmp_path / "acme.csv").write_text('year,metric,value,unit,scope,source,page\n2020,m,1.5,t,"a, ""b""",acme/2021_r.pdf,3\n2021,m,2,t,,acme/2022_r.pdf,\n')
    r = sources.read_figures(spark, str(tmp_path)).orderBy("ord").collect()
    assert (r[0].company, r[0].scope, r[0].page) == ("acme", 'a, "b"', 3) and r[1].scope is None and r[1].page is None
    assert sources.read_optional_json(spark, f"{tmp_path}/none.json", "a int").count() == 0
    (tmp_path / "pdf" / "acme").mkdir(parents=True)
    (tmp_path / "pdf" / "acme" / "2021_r.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "pdf" / "acme" / "2022_r.pdf").write_bytes(b"no")
    assert [(x.company, x.publish_year, x.is_pdf) for x in sources.report_files(spark, f"{tmp_path}/pdf", 2).orderBy("path").collect()] == [("acme", 2021, True), ("acme", 2022, False)]
    q = spark.createDataFrame([(1, [(2020, "http://x", None)]), (2, [(1999, "http://x", None)]), (3, []), (4, [(2020, "ftp://x", None)]), (5, [(2020, "http://x", "f")])], "id int, reports array<struct<year:int,url:string,file:string>>")
    assert [x.error for x in sources.validated_requests(q, 2024).orderBy("id").collect()] == [None, "year out of range", "no reports", "only http and https", "exactly one of url and file is needed"]


def test_revisions_as_a_stream(spark, tmp_path):
    from tidemark.streaming.revisions import revisions

    spark.createDataFrame([("a", 2019, "m", 10.0, 2020), ("a", 2019, "m", 12.0, 2021), ("a", 2018, "m", 1.0, 2020)], "company string, year int, metric string, value double, pub int").write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    q = revisions(s).writeStream.format("memory").queryName("revised").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.old, r.new, r.pct) for r in spark.table("revised").collect()] == [(10.0, 12.0, 20.0)]


def _taken_in_order(pairs):
    a, b, want = set(), set(), set()
    for rank, g, i, j in sorted(pairs, key=lambda p: (-p[0], p[2], p[3])):
        if (g, i) not in a and (g, j) not in b:
            a.add((g, i))
            b.add((g, j))
            want.add((g, i, j, rank))
    return want


def test_matched_pairs_equal_taking_all_pairs_in_order(spark, monkeypatch):
    from tidemark.operators import pairing

    r = random.Random(3)
    rows = [(g, r.choice("ab"), i, f"{r.choice(['red', 'blue', 'old', 'oldest'])} {r.choice(['ring', 'rings', 'bolt', 'red'])}") for g in range(4) for i in range(60)]
    t = spark.createDataFrame([*rows, (None, "a", 1, "red ring"), (0, "a", 99, None)], "g int, side string, id long, text string")
    every = [(round(x.similarity, 4), x.g, x.i, x.j) for x in matching.similarities(t, ["g"]).collect()]
    assert len(set(every)) == len(every) > 500
    got = lambda: {(x.g, x.i, x.j, x["rank"]) for x in matching.matched_pairs(t, ["g"], digits=4).collect()}
    want = _taken_in_order(every)
    assert got() == want
    for name, size in (("BLOCK", 5), ("GRAMS", 7), ("BAND", 10)):
        monkeypatch.setattr(pairing, name, size)
    assert got() == want


def test_equal_texts_are_compared_once(spark):
    # 400 equal rows a side: 160000 pairs of ids and one of texts; greedy_matches takes a round for each id
    t = spark.createDataFrame([("g", s, 2 * i + (s == "b"), "large ring") for s in "ab" for i in range(400)], "g string, side string, id long, text string")
    assert matching.similarities(t, ["g"]).count() == 160_000
    assert {(r.i, r.j) for r in matching.matched_pairs(t, ["g"]).collect()} == {(2 * i, 2 * i + 1) for i in range(400)}


def test_each_different_value_is_worked_out_once(spark):
    from tidemark.operators.common import once

    seen = []

    def work(t):
        seen.append(t.count())
        return t.withColumn("long", F.length("s"))

    df = spark.createDataFrame([(i, (None, "a", "bb")[i % 3]) for i in range(30)], "id int, s string")
    assert {(r.id, r.long) for r in once(df, "s", work).collect()} == {(i, (None, 1, 2)[i % 3]) for i in range(30)} and seen == [3]
    rows = [("d", 1, i, "We will cut carbon emissions by 30% by 2030. Short one.", 10.0, False) for i in range(9)]
    t = blocks.tagged_sentences(spark.createDataFrame([*rows, ("d", 2, 9, None, 10.0, False)], "doc string, page int, ord int, text string, size double, bold boolean"))
    assert {(r.outcome, r.n) for r in blocks.funnel(t).collect()} == {("kept", 9), ("length", 9)} and t.columns[5:8] == ["sentence", "drop_reason", "quantity"]
