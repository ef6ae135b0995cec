"""Near-duplicate documents by circulant MinHash.

Two permutations make all signature coordinates: sigma scatters a shingle over
a universe of ``UNIVERSE`` places (here the top bits of its 64-bit hash), and
pi, one fixed permutation of the places, is read at ``COORDINATES``
consecutive places from there, circularly.  Coordinate k is the smallest such
value over the document's shingles: k minhashes for one table look-up of
contiguous memory.  Bands of coordinates are the buckets; documents that share
one are candidates, and a link is confirmed on the whole shingle sets.

Documents of equal sets are one from the start.  In a bucket, every member is
first compared with the smallest one; then, in buckets that still hold several
components, members of different components are compared, where one-bit
sketches of the signatures don't rule the pair out.  So no group is expanded
into all its pairs, and no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage, lean
from .components import components
from .hashing import U64, Words, constants, mix64, windows
from .tokens import in_slices

SHINGLE = 5
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 75
UNIVERSE_BITS = 20
COORDINATES = 256
#: A pair at the threshold shares no band with probability (1 - 0.75 ** 5) ** 48 = 2e-6.
BANDS, ROWS = 48, 5
#: One-bit sketches of a pair at the threshold differ in 32 of 256 places on average, with a deviation of 5.3; this is 6.4 deviations above.
SKETCH_LIMIT = 66
#: The same of 4096 places: 512 on average, with a deviation of 21; this is 6.3 deviations above.
LONG = 4096
LONG_LIMIT = 645


class Circulant:
    """Signatures of shingle sets."""

    def __init__(self, coordinates: int = COORDINATES, bits: int = UNIVERSE_BITS):
        pi = np.argsort(mix64(np.arange(1 << bits, dtype=U64) + U64(101)), kind="stable").astype(np.uint32)
        self.shift, self.k = U64(64 - bits), coordinates
        self.slices = np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[:coordinates]]), coordinates)
        self.band = constants(ROWS, 41)
        self.which = constants(BANDS, 43)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        """Coordinates of one non-empty set."""
        at = (shingles >> self.shift).astype(np.int64)
        out = np.full(self.k, 0xFFFFFFFF, np.uint32)
        step = max(1, (1 << 17) // self.k)
        for a in range(0, len(at), step):
            np.minimum(out, self.slices[at[a : a + step]].min(0), out=out)
        return out

    def bands(self, signature: np.ndarray) -> np.ndarray:
        rows = signature[: BANDS * ROWS].reshape(BANDS, ROWS).astype(U64)
        return mix64((rows * self.band).sum(1, dtype=U64) + self.which).view(np.int64)

    def sketch(self, signature: np.ndarray) -> np.ndarray:
        return np.packbits((signature * np.uint32(0x9E3779B1) >> np.uint32(17) & np.uint32(1)).astype(bool)).view(np.int64)


def shingle_set(words: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of 5-word shingles; of the whole sequence if it is shorter; none without words."""
    n = min(len(words), SHINGLE)
    return np.unique(windows(words, n, 5 + n)) if n else words[:0]


def _each_set(texts: list[str | None]) -> Iterator[np.ndarray]:
    for a, b in in_slices(texts):
        words = Words(texts[a:b], lower=True)
        for k in range(b - a):
            yield shingle_set(words.of(k))


def _print_of(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit fingerprints of a set."""
    one, two = mix64(s ^ U64(0x5851F42D4C957F2D)), mix64(s + U64(0x14057B7EF767814F))
    with np.errstate(over="ignore"):
        return int(one.sum(dtype=U64).astype(np.int64)), int(two.sum(dtype=U64).astype(np.int64))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    make = Circulant()
    for batch in batches:
        rows = []
        for s in _each_set(batch.column(1).to_pylist()):
            if not len(s):
                rows.append((0, 0, 0, None, None))
                continue
            signature = make(s)
            rows.append((len(s), *_print_of(s), make.bands(signature).tolist(), make.sketch(signature).tolist()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_shingles", "p", "q", "bands", "sketch"])


def _long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    make = Circulant(LONG)
    for batch in batches:
        rows = [make.sketch(make(np.frombuffer(v.as_buffer(), U64))).tolist() for v in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int64()))], ["doc_id", "long"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        rows: list[tuple] = []
        for doc, s in zip(ids, _each_set(texts), strict=True):
            rows.append((doc, _print_of(s)[0] if len(s) else 0, s.tobytes()))
            if len(rows) == 256:
                yield _set_rows(rows)
                rows = []
        yield _set_rows(rows)


def _set_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["doc_id", "p", "shingles"])


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), U64) for v in (x, y))
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                common = int((large[at] == small).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs`` (doc_id, text; other columns are ignored).

    Words are lower-cased (A-Z).  component_id is the smallest doc_id reached
    over links; kept marks the rows whose own doc_id it is.  Null and empty
    texts, and texts of white space, have no shingles, link with nothing and
    are kept.  Rows with a null doc_id link with nothing, have a null
    component_id and are kept.  Rows that repeat a doc_id and text are each
    returned.  Rows that share a doc_id but not the text are one node: both
    texts' groups become one.  Texts are compared whole, however long.  An
    empty table gives no rows.  Rows in any order and partitioning give the
    same result.
    """
    stage = Stage(docs.sparkSession, "near-dedup")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = stage.write(docs.mapInArrow(lean(_signed), "doc_id long, n_shingles long, p long, q long, bands array<long>, sketch array<long>"))
    real = signed.where("n_shingles > 0 and doc_id is not null")
    first = stage.write(real.groupBy("p", "q", "n_shingles").agg(F.min("doc_id").alias("rep")))
    own = signed.select("doc_id", "p", "q", "bands", "sketch").join(first.select(F.col("rep").alias("doc_id"), "p", "q"), ["doc_id", "p", "q"]).dropDuplicates(["doc_id", "p", "q"])
    own = stage.write(own.select("doc_id", "p", "bands", "sketch"))

    rows = own.select("doc_id", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.min("doc_id").alias("pivot"), F.count("*").alias("n")).where("n > 1").select("key", "pivot")
    members = stage.write(rows.join(shared, "key"))
    sketches = own.select("doc_id", F.col("sketch").alias("s"))
    differ = sum((F.bit_count(F.col("x")[i].bitwiseXOR(F.col("y")[i])) for i in range(COORDINATES // 64)), F.lit(0))

    needed = members.select("doc_id").distinct().join(own.select("doc_id", "p"), "doc_id")
    sets = docs.join(needed.select("doc_id"), "doc_id", "left_semi").mapInArrow(lean(_sets), "doc_id long, p long, shingles binary")
    sets = stage.write(sets.join(needed, ["doc_id", "p"], "left_semi").select("doc_id", "shingles"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        with_b = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("t")), "b")
        with_both = with_b.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("s")), "a").select("a", "b", "s", "t")
        return with_both.mapInArrow(lean(_confirmed(percent)), "a long, b long")

    star = members.where("pivot <> doc_id").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")).distinct()
    star = star.join(sketches.select(F.col("doc_id").alias("a"), F.col("s").alias("x")), "a").join(sketches.select(F.col("doc_id").alias("b"), F.col("s").alias("y")), "b")
    star = stage.write(star.where(differ <= SKETCH_LIMIT).select("a", "b"))
    links = stage.write(confirmed(star))
    labels = components(links, stage)

    placed = members.select("key", "doc_id").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("label", "doc_id").alias("label"))
    placed = stage.write(placed)
    several = placed.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least < most").select("key")
    open_rows = stage.write(placed.join(several, "key"))
    details = sets.join(open_rows.select("doc_id").distinct(), "doc_id", "left_semi").mapInArrow(lean(_long), "doc_id long, long array<long>")
    details = stage.write(details.join(own.select("doc_id", F.col("sketch").alias("s"), F.transform("bands", lambda k: k.bitwiseAND(0x7FFFFFFF).cast("int")).alias("bands")), "doc_id"))
    open_rows = open_rows.join(details, "doc_id").select("key", "doc_id", "label", "s", "long", "bands")
    left = open_rows.toDF("key", "a", "la", "x", "lx", "bx")
    right = open_rows.toDF("key2", "b", "lb", "y", "ly", "by")
    differ_long = sum((F.bit_count(F.col("lx")[i].bitwiseXOR(F.col("ly")[i])) for i in range(LONG // 64)), F.lit(0))
    # a pair is looked at once: in the first bucket that it shares
    first_shared = F.element_at("bx", F.array_position(F.zip_with("bx", "by", lambda v, w: v == w), True).cast("int")) == F.col("key").bitwiseAND(0x7FFFFFFF).cast("int")
    across = left.join(right, (left["key"] == right["key2"]) & (F.col("la") < F.col("lb")) & (differ <= SKETCH_LIMIT) & (differ_long <= LONG_LIMIT) & first_shared)
    across = across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(star, ["a", "b"], "left_anti")
    more = stage.write(confirmed(stage.write(across)))
    labels = components(links.unionByName(more), stage)

    named = first.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("p", "q", F.coalesce("label", "rep").alias("component"))
    out = signed.select("doc_id", "n_shingles", "p", "q").join(named, ["p", "q"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs``, all its columns as they were, with one document of each group: that of the smallest doc_id.

    Rows that share a doc_id stay or go together.  Null, empty and blank texts
    and null doc_ids stay.
    """
    gone = near_duplicates(docs, percent).where("not kept").select(F.col("doc_id").alias("of")).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == gone["of"], "left_anti")
