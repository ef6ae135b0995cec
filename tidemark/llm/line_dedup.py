"""Repeated runs of lines, by a suffix array over line ids and its longest common prefixes.

A document is a sequence of line ids.  Suffixes of these sequences are sorted by
distributed prefix doubling: their order by the first 2h lines follows from
their ranks by the first h, of the suffix itself and of the one h lines on.
Suffixes with the same first h lines lie together in the suffix array: an
interval of longest common prefix h or more, whose rank is the number of
suffixes before it.  A suffix alone in its interval repeats nothing and leaves,
so only the array's intervals are held.  Between h and 2h, a length's order
follows likewise from the ranks of its two parts, so a round gives all lengths
from h + 1 to 2h, and a suffix's longest common prefix with an earlier one is
known to the line.

Maximal repeated runs of ``min_words`` words or more are deleted, however many
lines they have.  Every line that is not blank has a word, so each line of such
a run lies in a piece of it of ``min_words`` lines or fewer that has the words
alone; a piece of a later copy is a later copy.  Common prefixes are therefore
told apart up to ``min_words`` lines, and the union of the pieces is exactly
that of the maximal runs.

Everything is DataFrame and SQL functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Stage

#: A run is deleted if it holds this many words or more.
MIN_WORDS = 8
#: White space at either end of a line does not count.
ENDS = " \t\r\x0b\x0c"

#: A document's rows of equal id and text are one; nulls are equal here.
_PLACE = ("doc_id", "t", "n")


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value worked out once however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _sequence(lines: Column) -> Column:
    """Lines that are not blank: their place among all lines, and the line trimmed."""
    return F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.btrim(x, F.lit(ENDS)).alias("line"))), lambda s: s["line"] != "")


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _ranked(intervals: DataFrame, by: list[str], stage: Stage) -> DataFrame:
    """``intervals`` with rank: the suffixes in intervals before, in the order of the columns ``by``.

    Sorted in ranges; a range's rank begins with the suffixes of the ranges
    before, of which there are as many as partitions.
    """
    ranges = stage.write(intervals.repartitionByRange(*by).withColumn("range", F.spark_partition_id()))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    begins = ranges.groupBy("range").agg(F.sum("size").alias("of")).withColumn("begin", F.coalesce(F.sum("of").over(before), F.lit(0))).drop("of")
    within = Window.partitionBy("range").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    out = ranges.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0))).join(F.broadcast(begins), "range")
    out = stage.write(out.withColumn("rank", F.col("begin") + F.col("within")).drop("range", "begin", "within", "size"))
    stage.drop(ranges)
    return out


def _in_intervals(suffixes: DataFrame, by: list[str], stage: Stage) -> DataFrame:
    """The suffixes not alone in their interval, with its rank and whether an earlier suffix is in it."""
    # written, so that the join has exchanges on both sides and a very common line's suffixes can be split
    intervals = suffixes.groupBy(*by).agg(F.count("*").alias("size"), F.min(F.struct(*_PLACE)).alias("first")).where("size > 1")
    intervals = _ranked(stage.write(intervals), by, stage)
    return suffixes.join(intervals, by).withColumn("later", F.struct(*_PLACE) > F.col("first")).drop("first", *(c for c in by if c != "h"))


def common_prefixes(docs: DataFrame, stage: Stage, longest: int) -> DataFrame:
    """doc_id, t (hash of the text), n, lcp: the places (lines that are not blank, from 0) whose suffix has its first lcp lines, ``longest`` at most, in common with an earlier one."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("t"), F.posexplode(_sequence(_lines(F.col("text")))).alias("n", "s"))
    now = lines.select(*_PLACE, F.lit(1).alias("h"), F.xxhash64("s.line").alias("a"), F.xxhash64("s.line", F.lit(1)).alias("b"))
    found = [_in_intervals(now, ["h", "a", "b"], stage)]
    ranks = stage.write(found[0].groupBy(*_PLACE).agg(F.first("rank").alias("r1"), F.first("later").alias("later")))
    found = [ranks.where("later").select(*_PLACE, F.lit(1).alias("h"))]
    half, state = 1, ranks.drop("later")
    while half < longest and not state.isEmpty():
        ahead = Window.partitionBy("doc_id", "t").orderBy("n")
        on = F.lead(F.struct("n", *(f"r{k}" for k in range(1, half + 1))), half).over(ahead)
        parts = state.withColumn("on", F.when(on["n"] == F.col("n") + half, on))
        lengths = range(half + 1, min(2 * half, longest) + 1)
        pairs = F.array(*(F.when(F.col("on")[f"r{h - half}"].isNotNull() & F.col(f"r{half}").isNotNull(), F.struct(F.lit(h).alias("h"), F.col(f"r{half}").alias("a"), F.col("on")[f"r{h - half}"].alias("b"))) for h in lengths))
        pairs = parts.select(*_PLACE, F.explode(F.filter(pairs, lambda p: p.isNotNull())).alias("p")).select(*_PLACE, "p.*")
        of = stage.write(_in_intervals(stage.write(pairs), ["h", "a", "b"], stage))
        found.append(of.where("later").select(*_PLACE, "h"))
        if 2 * half >= longest:
            break
        more = of.groupBy(*_PLACE).agg(*(F.max(F.when(F.col("h") == h, F.col("rank"))).alias(f"r{h}") for h in lengths))
        # what is alone at every new length still follows others as their second part
        both = state.join(more.select(*(F.col(c).alias(f"_{c}") for c in _PLACE), *(f"r{h}" for h in lengths)), F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("t") == F.col("_t")) & (F.col("n") == F.col("_n")), "left")
        state = stage.write(both.select(*state.columns, *(f"r{h}" for h in lengths)))
        half *= 2
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.groupBy(*_PLACE).agg(F.max("h").alias("lcp"))


def without_repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` (doc_id, text and any others) with n_lines, n_removed and kept (the text left), replacing columns of those names.

    Lines end at \\n and are compared without white space at their ends; blank
    lines are kept, and count for nothing.  A line is removed if it lies in a
    run of any number of lines, of ``min_words`` words or more, that also begins
    at an earlier place: smaller doc_id (null first), or further up in the same
    text.  Kept lines are left as they are.  Null text stays null, with no
    lines; empty text has none either, and an empty table gives no rows.  Rows
    equal in doc_id and text are one place: what is removed from one is
    removed from all.  Rows of one doc_id with different texts are different
    places, in the order of the texts' hashes.  A very long text is one row
    of the result, as of the input; its lines are spread in between.
    """
    stage = Stage(docs.sparkSession, "line-dedup")
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed", "kept")]
    # whatever the caller's columns are called, they are out of the way in one
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row")).withColumns({"doc_id": F.col("row.doc_id"), "text": F.col("row.text"), "hash": F.xxhash64("row.text")})
    runs = common_prefixes(docs.select("doc_id", "text"), stage, min_words)
    runs = stage.write(runs.groupBy("doc_id", "t").agg(F.collect_list(F.struct("n", "lcp")).alias("runs"))).withColumnRenamed("doc_id", "of")
    both = rows.join(runs, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("hash") == F.col("t")), "left")

    def left(x: Column) -> Column:
        """From the lines, those not blank, their words, and the runs, to what is left."""
        long = F.filter(x["runs"], lambda r: F.aggregate(F.slice(x["words"], r["n"] + 1, r["lcp"]), F.lit(0), lambda a, w: a + w) >= min_words)
        gone = F.array_distinct(F.flatten(F.transform(long, lambda r: F.transform(F.slice(x["seq"], r["n"] + 1, r["lcp"]), lambda s: s["i"]))))
        return _let(
            F.struct(x["lines"].alias("lines"), gone.alias("gone"), F.size(x["seq"]).alias("n")),
            lambda y: F.struct(y["n"].alias("n"), F.size(y["gone"]).alias("gone"), F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(y["lines"]) - 1), y["gone"]), lambda i: F.get(y["lines"], i)), "\n").alias("kept")),
        )

    with_lines = lambda f: _let(F.struct(_lines(F.col("text")).alias("lines")), lambda x: _let(F.struct(x["lines"].alias("lines"), _sequence(x["lines"]).alias("seq")), f))
    with_words = lambda x: _let(F.struct(x["lines"].alias("lines"), x["seq"].alias("seq"), F.transform(x["seq"], lambda s: F.regexp_count(s["line"], F.lit(WORD))).alias("words"), F.col("runs").alias("runs")), left)
    untouched = lambda x: F.struct(F.size(x["seq"]).alias("n"), F.lit(0).alias("gone"), F.col("text").alias("kept"))
    out = both.select("row", F.when(F.col("runs").isNull(), with_lines(untouched)).otherwise(with_lines(with_words)).alias("out"))
    return out.select("row.*", F.col("out.n").cast("long").alias("n_lines"), F.col("out.gone").cast("long").alias("n_removed"), F.col("out.kept").alias("kept"))


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """``docs``, all its columns as they were, with later copies of runs of lines deleted from text; rows that lose all their lines go, all others stay."""
    row = docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    out = without_repeated_runs(row, **options).where("n_removed = 0 or n_removed < n_lines")
    return out.select(F.col("row").withField("text", F.col("kept")).alias("row")).select("row.*")


#: The same in SQL, for the table documents: of every run of 1 to 8 lines, whether it begins earlier too.
ORACLE = r"""
WITH lines AS (
  SELECT doc_id, i, trim(line, E' \t\r\x0b\x0c') AS line
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
  WHERE trim(line, E' \t\r\x0b\x0c') <> ''
), seq AS (
  SELECT doc_id, i, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n,
    len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM lines
), eight AS (
  SELECT doc_id, n, list(line) OVER d AS line, list(w) OVER d AS w FROM seq WINDOW d AS (PARTITION BY doc_id ORDER BY n ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)
), runs AS (
  SELECT doc_id, n, h, md5(array_to_string(line[1:h], chr(10))) AS name, list_sum(w[1:h]) AS w FROM eight, range(1, 9) AS r(h) WHERE h <= len(line)
), later AS (
  SELECT doc_id, n, h FROM (SELECT doc_id, n, h, w, row_number() OVER (PARTITION BY h, name ORDER BY doc_id, n) AS k FROM runs) WHERE k > 1 AND w >= 8
), gone AS (
  SELECT DISTINCT s.doc_id, s.i FROM seq s JOIN later l ON s.doc_id = l.doc_id AND s.n >= l.n AND s.n < l.n + l.h
), everything AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents
), kept AS (
  SELECT e.doc_id, coalesce(string_agg(e.line, chr(10) ORDER BY e.i) FILTER (WHERE g.i IS NULL), '') AS kept, count(g.i) AS n_removed
  FROM everything e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id
)
SELECT d.doc_id, coalesce(s.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed, sha256(k.kept) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id LEFT JOIN (SELECT doc_id, count(*) AS n_lines FROM seq GROUP BY doc_id) s ON d.doc_id = s.doc_id
"""
