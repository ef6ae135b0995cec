import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import slots, text
from tidemark.functions.lexicon import Lexicon, Settings
from tidemark.functions.numbers import fixed, plain_number, py_round


def _one(spark, s, **columns):
    return spark.createDataFrame([(s,)], "s string").select(*(c.alias(n) for n, c in columns.items())).first()


@settings(max_examples=3, deadline=None)
@given(st.lists(st.one_of(st.floats(-1e6, 1e6), st.integers(-10**6, 10**6).map(lambda i: i / 1000), st.sampled_from([2.675, 0.125, 2.5, -0.5, 1.005])), min_size=50, max_size=200))
def test_rounding_is_pythons(spark, xs):
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", *(py_round(F.col("x"), d).alias(f"r{d}") for d in (0, 1, 2, 4))).collect()
    for r in rows:
        for d in (0, 1, 2, 4):
            assert r[f"r{d}"] == round(r["x"], d)


def test_numbers_as_text(spark):
    xs = [(5.0, "5"), (1234567.0, "1234567"), (0.5, "0.5"), (49.02, "49.02"), (123.456, "123.5"), (0.00012345, "0.0001234"), (None, None), (-2.25, "-2.25")]
    got = spark.createDataFrame([(x,) for x, _ in xs], "x double").select(plain_number(F.col("x")).alias("t")).collect()
    assert [g.t for g in got][:5] == [t for _, t in xs][:5] and got[6].t is None and got[7].t == "-2.25"


def test_text(spark):
    r = _one(spark, "We cut  energy. See more. 2 goals!", a=text.squeeze(F.col("s")), b=text.sentences(F.col("s")), c=text.words(F.col("s")), d=text.reading_ease(F.col("s")))
    assert r.a == "We cut energy. See more. 2 goals!" and r.b[-1] == "2 goals!" and r.c == ["We", "cut", "energy", "See", "more", "goals"] and r.d is not None
    assert _one(spark, "a b", d=text.reading_ease(F.col("s"))).d is None
    assert spark.range(1).select(text.join_lines(F.array(F.lit("pack- "), F.lit(" aging is"), F.lit(""))).alias("j")).first().j == "packaging is"
    assert _one(spark, "significantly world-leading", n=text.prefix_hits(F.col("s"), ("significant", "significantly", "leading", "world-leading"))).n == 4
    assert _one(spark, "Lessignificant", n=text.prefix_hits(F.col("s"), ("significant",))).n == 0
    assert _one(spark, "Renewable energy . . . . . . 30", n=text.navigational(F.col("s"))).n and not _one(spark, "We cut waste.", n=text.navigational(F.col("s"))).n
    assert [x.n for x in spark.createDataFrame([("6) This",), ("60 tonnes",)], "s string").select(text.without_footnote_mark(F.col("s")).alias("n")).collect()] == ["This", "60 tonnes"]


def test_slots_of_edge_cases(spark):
    cases = [
        ("In 2021 the group was listed.", "quantity", ""), ("Our scope 3 emissions matter.", "quantity", ""), ("We cut 2,019 tonnes of waste.", "quantity", "2,019"), ("We cut 2,519 tonnes of waste.", "quantity", "2,519 tonnes"),
        ("We cut 30 % by 2030.", "quantity", "30 %"), ("We will reduce by 2030.", "deadline", "2030"), ("Cut 5% against a 2019 base year.", "baseline", "2019"), ("We will not reduce waste.", "negated", True),
        ("We will cut not only cost but also waste.", "negated", False), ("We won't and will reduce waste.", "negated", False), ("We will act by 2030 if rules allow.", "conditional", True), ("We will act, if asked.", "conditional", True),
        ("We aim to, and will, cut.", "strength", "firm"), ("We may cut.", "strength", "hedged"), ("Emissions were cut.", "strength", "achievement"), ("Nothing here.", "strength", ""),
        ("Our own operations and our operations.", "scope", "own operations"), ("Recyclable bags.", "claim_type", "attribute"), ("We achieved 5% less.", "claim_type", "achievement"), ("We aim for a target.", "claim_type", "target"),
        ("", "quantity", ""), (None, "strength", ""),
    ]
    df = spark.createDataFrame([(i, s) for i, (s, _, _) in enumerate(cases)], "i int, sentence string")
    got = {r.i: r for r in slots.with_slots(df, Lexicon()).collect()}
    for i, (s, field, want) in enumerate(cases):
        assert got[i][field] == want, (s, field, got[i][field])


def test_gates(spark):
    ok = "We will cut carbon emissions by 30% by 2030."
    rows = [(ok, None), ("Too short 5.", "length"), ("no capital but carbon at 5 percent here.", "shape"), ("Read more about carbon 5 on page 80.", "navigational"), ("We like our many customers a lot.", "no candidate")]
    got = spark.createDataFrame(rows, "s string, want string").select("want", slots.drop_reason(F.col("s"), Lexicon()).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_configuration_overlays_defaults():
    s = Settings.of({"min_components": 2, "drift": {"rate_weight": 0.5, "unknown": 1}, "confidence": {"min_verified_quotes_for_high": 9}, "weights": {"vagueness": 1}})
    assert s.min_components == 2 and s.rate_weight == 0.5 and s.quotes_for_high == 9 and s.weights == {"vagueness": 1} and s.magnitude_weight == 0.40
    x = Lexicon.of({"vague": ["Big"], "positive_tone": ["Yay"], "metric_families": {"a": ["B"]}})
    assert x.vague == ("big",) and x.positive == ("yay",) and x.families == (("a", ("b",)),) and "carbon" in x.core and "material" not in x.core
    assert math.isclose(Settings().actuals_block_weight + Settings().targets_block_weight, 1)


def test_configuration_files(tmp_path):
    from tidemark.sources.config import read_lexicon, read_settings

    (tmp_path / "c.json").write_text('{"vague": ["Huge"], "drift": {"rate_weight": 1}}')
    assert read_lexicon(f"{tmp_path}/c.json").vague == ("huge",) and read_settings(f"{tmp_path}/c.json").rate_weight == 1


def test_fixed_digits_are_python_s(spark):
    xs = [6.25, 6.35, -6.25, 0.15, -0.04, 0.0, 12.75, -100.0, 99.95, None]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").select("i", fixed(F.col("x"), 1, plus=True).alias("signed"), fixed(F.col("x"), 2).alias("plain")).orderBy("i").collect()
    assert [r.signed for r in rows] == [None if x is None else f"{x:+.1f}" for x in xs]
    assert [r.plain for r in rows] == [None if x is None else f"{x:.2f}" for x in xs]
