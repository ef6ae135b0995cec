"""Mixing sources to target weights by pivotal dependent rounding.

Each document of a source has the same number of copies to be taken, in
general not whole.  The whole part is taken; the fractional parts are rounded
together: two documents at a time, mass is moved at random from one to the
other, with their words' weighted sum unchanged, until one of them is 0 or 1.
The one that is not goes on to the next pair.  Blocks of at most about
``BLOCK`` documents are rounded at once, each leaves at most one fractional
document, and these meet in blocks of the next level: a reduction tree over
which no task ever holds more than a block, however large a source is.

Everything is DataFrame and SQL functions.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Stage

#: Documents that are rounded at once (on average, at the lowest level; at most, above).
BLOCK = 64
SEED = 20240517


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Target words of each source, one row per source.

    ``sizes`` has source, source_size and n (one row per source).  Sources in
    code-point order, null last, weigh ``weights``, repeating.  They share
    ``share`` of all words by weight; a target stops at ``cap`` times its
    source's size, and the excess is shared again by weight: with sources in
    the order of cap per weight, a prefix is at its cap and the rest have the
    same words per weight, so running sums find the level directly.
    """
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))) - 1) % len(weights) + 1)
    t = sizes.withColumn("weight", w).withColumn("most", F.col("source_size") * F.lit(cap))
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    t = t.withColumn("level", level)
    # the first source, in that order, whose cap is above its level sets the level of itself and of those after it
    found = F.min(F.when(F.col("most") > F.col("level") * F.col("weight"), F.struct(F.col("most") / F.col("weight"), "level"))).over(everything)["level"]
    return t.withColumn("target", F.least(F.col("most"), F.coalesce(found * F.col("weight"), F.col("most")))).drop("level", "most", "weight")


_UNIT = "struct<doc_id:bigint,size:bigint,x:double,tie:bigint,nth:bigint>"


def _rounded(units: str, seed: int) -> str:
    """SQL for: fold an array of units; gives the settled ones (x is 0 or 1) and the one that is left, or null.

    The fold's accumulator has the unit at hand (left) and the settled ones.
    up: the words that can be moved to the one at hand; down: from it.
    """
    uniform = f"(shiftrightunsigned(xxhash64(a.left.doc_id, a.left.tie, a.left.nth, u.doc_id, u.tie, u.nth, {seed}L), 11) / 9007199254740992D)"
    pair = (
        "named_struct('up', least((1D - a.left.x) * a.left.size, u.x * u.size), 'down', least(a.left.x * a.left.size, (1D - u.x) * u.size),"
        " 'up_fills', (1D - a.left.x) * a.left.size <= u.x * u.size, 'up_empties', u.x * u.size <= (1D - a.left.x) * a.left.size,"
        f" 'down_empties', a.left.x * a.left.size <= (1D - u.x) * u.size, 'down_fills', (1D - u.x) * u.size <= a.left.x * a.left.size, 'r', {uniform})"
    )
    moved = (
        "named_struct('first', CASE WHEN p.r * (p.up + p.down) < p.down THEN if(p.up_fills, 1D, a.left.x + p.up / a.left.size) ELSE if(p.down_empties, 0D, a.left.x - p.down / a.left.size) END,"
        " 'second', CASE WHEN p.r * (p.up + p.down) < p.down THEN if(p.up_empties, 0D, u.x - p.up / u.size) ELSE if(p.down_fills, 1D, u.x + p.down / u.size) END)"
    )
    first = "named_struct('doc_id', a.left.doc_id, 'size', a.left.size, 'x', m.first, 'tie', a.left.tie, 'nth', a.left.nth)"
    second = "named_struct('doc_id', u.doc_id, 'size', u.size, 'x', m.second, 'tie', u.tie, 'nth', u.nth)"
    whole = lambda v: f"(m.{v} <= 0D OR m.{v} >= 1D)"
    after = (
        f"CASE WHEN {whole('first')} AND {whole('second')} THEN named_struct('left', CAST(NULL AS {_UNIT}), 'settled', concat(a.settled, array({first}, {second})))"
        f" WHEN {whole('first')} THEN named_struct('left', {second}, 'settled', concat(a.settled, array({first})))"
        f" ELSE named_struct('left', {first}, 'settled', concat(a.settled, array({second}))) END"
    )
    step = f"element_at(transform(array({pair}), p -> element_at(transform(array({moved}), m -> {after}), 1)), 1)"
    start = f"named_struct('left', CAST(NULL AS {_UNIT}), 'settled', CAST(array() AS array<{_UNIT}>))"
    return f"aggregate({units}, {start}, (a, u) -> CASE WHEN a.left IS NULL THEN named_struct('left', u, 'settled', a.settled) ELSE {step} END)"


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """doc_id, source, size, source_size, target, tie (hash of the text), nth, copies, part, taken: how much of each row of ``docs`` the mix takes.

    ``docs`` has doc_id, text and source; further columns are ignored.  copies
    is a whole number of times, part the words taken once more from the one
    document that a source's rounding leaves fractional (0 for all others), so
    taken = copies * size + part and a source's sum is its target to within a
    word.  Null text has size 0; documents of size 0, empty texts among them,
    take nothing and never enter the rounding.  A very long text is one size.
    A null source is a source.  Rows equal in doc_id, source, size and text
    stay separate rows, told apart by nth from 1 on, and are rounded in blocks
    of their own.  An empty table gives no rows.  The choice depends on doc_id,
    size, text and seed, not on how the rows are partitioned.
    """
    stage = Stage(docs.sparkSession, "mixing")
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("tie"))
    # equal rows are counted, then dealt out again with numbers, so that however many there are they fall into many blocks
    sized = sized.groupBy("doc_id", "source", "size", "tie").agg(F.count("*").alias("rows"))
    sized = stage.write(sized.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))).drop("rows"))
    per = stage.write(targets(sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count_if(F.col("size") > 0).alias("n")), weights, share, cap))
    # the sources' table is joined, not assumed small: Spark broadcasts it only under its size threshold
    given = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    both = sized.alias("d").join(per.select(F.col("source").alias("of"), "source_size", "target", "n"), F.col("d.source").eqNullSafe(F.col("of"))).drop("of")
    both = both.withColumn("given", given).withColumn("copies", F.floor("given")).withColumn("x", F.col("given") - F.floor("given"))
    whole = (F.col("size") == 0) | (F.col("x") <= 1e-12) | (F.col("x") >= 1 - 1e-12)
    keep = ["doc_id", "source", "size", "source_size", "target", "tie", "nth"]
    parts = [both.where(whole).select(*keep, F.when(F.col("size") == 0, F.lit(0)).otherwise(F.round("given")).cast("long").alias("copies"), F.lit(0).cast("long").alias("part"))]
    per_source = ["source", "source_size", "target", "given", "blocks"]
    units = both.where(~whole).withColumn("blocks", F.ceil(F.col("n") / block)).withColumn("block", F.pmod(F.xxhash64("doc_id", "tie", "nth", F.lit(seed)), F.col("blocks")))
    most = per.agg(F.max("n")).first()[0] or 0
    levels = max(1, math.ceil(math.log(max(most, 1), block) - 1e-9))
    for level in range(levels + 1):
        grouped = units.groupBy(*per_source, "block").agg(F.sort_array(F.collect_list(F.struct(F.xxhash64("doc_id", "tie", "nth", F.lit(seed + level)).alias("order"), "doc_id", "size", "x", "tie", "nth"))).alias("units"))
        plain = F.expr("transform(units, u -> named_struct('doc_id', u.doc_id, 'size', u.size, 'x', u.x, 'tie', u.tie, 'nth', u.nth))")
        done = stage.write(grouped.withColumn("units", plain).withColumn("done", F.expr(_rounded("units", seed + level))).drop("units"))
        settled = done.select(*per_source, F.explode("done.settled").alias("u"))
        parts.append(settled.select("u.doc_id", "source", "u.size", "source_size", "target", "u.tie", "u.nth", (F.floor("given") + F.round("u.x")).cast("long").alias("copies"), F.lit(0).cast("long").alias("part")))
        left = done.where("done.left IS NOT NULL").select(*per_source, F.floor(F.col("block") / block).cast("long").alias("block"), "done.left.*")
        if level == levels:
            parts.append(left.select(*keep, F.floor("given").cast("long").alias("copies"), F.round(F.col("x") * F.col("size")).cast("long").alias("part")))
        units = left
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("taken", F.col("copies") * F.col("size") + F.col("part"))


_KEY = ("doc_id", "source", "size", "tie")


def _numbered(rows: DataFrame, stage: Stage) -> DataFrame:
    """``rows`` (the key, row) with nth among those of equal key: counted by partition, so that no task holds all of one key."""
    rows = stage.write(rows.withColumn("dealt", F.spark_partition_id()))
    before = Window.partitionBy(*_KEY).orderBy("dealt").rowsBetween(Window.unboundedPreceding, -1)
    begins = rows.groupBy(*_KEY, "dealt").agg(F.count("*").alias("n")).withColumn("begin", F.coalesce(F.sum("n").over(before), F.lit(0)))
    begins = stage.write(begins.select(*(F.col(c).alias(f"{c}_") for c in (*_KEY, "dealt")), "begin"))
    own = F.row_number().over(Window.partitionBy(*_KEY, "dealt").orderBy(F.lit(1)))
    same = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in (*_KEY, "dealt")]
    return rows.withColumn("own", own).join(begins, reduce(and_, same)).select(*_KEY, "row", (F.col("begin") + F.col("own")).alias("nth"))


def materialise(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as its copies say, all its columns as they were, whatever they are called.

    Texts are never cut: the document that a source leaves fractional is taken
    once more if at least half of it was due.  Rows are matched on doc_id,
    source, size, text and, where equal in these, dealt the copies of their
    like one by one.  Rows of size 0 (null, empty and blank texts) carry no
    words and are not in the mix.  An empty table stays empty.
    """
    stage = Stage(docs.sparkSession, "materialise")
    taken = mix(docs, **options)
    taken = taken.withColumn("copies", F.col("copies") + (2 * F.col("part") >= F.greatest(F.col("size"), F.lit(1))).cast("long"))
    taken = stage.write(taken.where("size > 0").select(*(F.col(c).alias(f"{c}_") for c in _KEY), F.col("nth").alias("nth_"), "copies"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    rows = rows.select(F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.source").alias("source"), word_count(F.col("row.text")).alias("size"), F.coalesce(F.xxhash64("row.text"), F.lit(0)).alias("tie"), "row").where("size > 0")
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in _KEY])
    repeated = stage.write(taken.where("nth_ = 2").select(*(f"{c}_" for c in _KEY)))
    one, several = rows, None
    if not repeated.isEmpty():
        one, several = rows.join(repeated, same, "left_anti"), _numbered(rows.join(repeated, same, "left_semi"), stage)
    out = one.join(taken.where("nth_ = 1 and copies > 0"), same).select("row", "copies")
    if several is not None:
        out = out.unionByName(several.join(taken.where("copies > 0"), same & (F.col("nth") == F.col("nth_"))).select("row", "copies"))
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")
