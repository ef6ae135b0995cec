"""Repeated word windows by level-wise doubling.

Windows of ``WINDOW`` words that begin at more than one place are found level
by level: for 35 words, those of 9, 18 and 35.  Windows that are found at one
place alone go; the others are extended to about twice their length, and so on
until the full length is reached or nothing survives.

A full window is stood for, at each lower level, by one window in it.  At the
lowest level that is the one with the smallest hash, its anchor; at the levels
above, the window that begins with the anchor or, where the full window ends
too soon for that, the one that ends with it.  All follow from the words of the
full window alone, so two equal full windows are stood for by equal windows, and
a full window repeats only if these do.  Neighbouring full windows share their
anchors, so about one place in fourteen is looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage, lean
from .hashing import U64, Words, mix64, windows_rolling
from .tokens import in_slices

WINDOW = 35


#: The lowest level's windows are shorter than this.
SHORT = 12


def lengths(window: int) -> list[int]:
    """Lengths of the levels' windows, each at most twice the one before."""
    out = [window]
    while out[0] >= SHORT or len(out) < 2:
        out.insert(0, (out[0] + 1) // 2)
    return out


def _least_of(short: np.ndarray, span: int) -> np.ndarray:
    """For each run of ``span`` consecutive hashes, the place of its smallest (the first, where equal)."""
    place, step = np.arange(len(short), dtype=np.int32), 1
    while step * 2 <= span:  # doubling: the least of 1, 2, 4 ... places
        a, b = place[:-step], place[step:]
        place = np.where(short[b] < short[a], b, a)
        step *= 2
    m = len(short) - span + 1
    a, b = place[:m], place[span - step : span - step + m]
    return np.where(short[b] < short[a], b, a)


class Levels:
    """One text's windows: for each full window the places of those that stand for it, and hashes."""

    def __init__(self, words: np.ndarray, window: int):
        self.words, self.lengths = words, lengths(window)
        self.m = max(0, len(words) - window + 1)
        if self.m:
            self.anchor = _least_of(self.hashes(0), window - self.lengths[0] + 1)

    def hashes(self, level: int) -> np.ndarray:
        return windows_rolling(self.words, self.lengths[level], 53)

    def places(self, level: int) -> np.ndarray:
        """Of each full window: where the window of this level begins that stands for it."""
        length = self.lengths[level]
        if not self.m or length == self.lengths[-1]:
            return np.arange(self.m, dtype=np.int32)
        if not level:
            return self.anchor
        room = np.arange(self.lengths[-1] - length, self.m + self.lengths[-1] - length, dtype=np.int32)
        return np.where(self.anchor <= room, self.anchor, self.anchor + np.int32(self.lengths[0] - length))

    def extended(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash one level below, hash) of the windows of this level, once for each pair of places; at level 0 the hash twice."""
        if not self.m:
            return np.zeros(0, U64), np.zeros(0, U64)
        at, below = self.places(level), self.places(max(0, level - 1))
        # equal pairs follow one another
        new = np.append(True, (at[1:] != at[:-1]) | (below[1:] != below[:-1]))
        at, below = at[new], below[new]
        own = self.hashes(level)[at]
        return (self.hashes(level - 1)[below] if level else own), own


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed before they are shuffled: about half of what the shuffle's own compression makes of them."""
    for batch in batches:
        z = zstandard.ZstdCompressor(level=1)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([z.compress(t.encode()) for t in batch.column(2).to_pylist()], pa.binary())], ["doc_id", "key", "packed"])


def _unpacked(column: pa.Array) -> list[str]:
    z = zstandard.ZstdDecompressor()
    return [z.decompress(p).decode() for p in column.to_pylist()]


def _each(texts: list[str], window: int):
    """(row, its windows) for each row."""
    for a, b in in_slices(texts):
        words = Words(texts[a:b], lower=False)
        for k in range(b - a):
            yield a + k, Levels(words.of(k), window)


def _second(words: np.ndarray, n: int) -> np.ndarray:
    """A second hash of the full windows, independent of the first."""
    return windows_rolling(mix64(words ^ U64(0xA0761D6478BD642F)), n, 59)


def _emit(columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def _level(window: int, level: int):
    """From (key, text) to (key, hash one level below, hash) of the windows of a level; at level 0 to (key, hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "below", "h"] if level else ["key", "h"]
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            parts: list[tuple] = []
            size = 0
            for row, levels in _each(batch.column(1).to_pylist(), window):
                below, own = levels.extended(level)
                parts.append((np.full(len(own), keys[row], np.int64), *([below.view(np.int64)] if level else []), own.view(np.int64)))
                size += len(own)
                if size > 1 << 18:
                    yield _emit([np.concatenate(c) for c in zip(*parts, strict=True)], names)
                    parts, size = [], 0
            if size:
                yield _emit([np.concatenate(c) for c in zip(*parts, strict=True)], names)

    return run


def _full(window: int):
    """From (key, text, repeated hashes of the level below) to (key, place, two hashes) of the full windows they may grow to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = len(lengths(window)) - 2
        names = ["key", "place", "h", "g"]
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            parts: list[tuple] = []
            size = 0
            for row, levels in _each(_unpacked(batch.column(1)), window):
                if not levels.m:
                    continue
                repeated = np.frombuffer(batch.column(2)[row].values.to_numpy(zero_copy_only=False).astype(np.int64), U64)
                at = np.flatnonzero(np.isin(levels.hashes(last), repeated)[levels.places(last)])
                parts.append((np.full(len(at), keys[row], np.int64), at.astype(np.int32), levels.hashes(last + 1)[at].view(np.int64), _second(levels.words, window)[at].view(np.int64)))
                size += len(at)
                if size > 1 << 18:
                    yield _emit([np.concatenate(c) for c in zip(*parts, strict=True)], names)
                    parts, size = [], 0
            if size:
                yield _emit([np.concatenate(c) for c in zip(*parts, strict=True)], names)

    return run


def _kept(window: int):
    """From (doc_id, text, places of repeated full windows or null) to what is left of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, places = _unpacked(batch.column(1)), batch.column(2)
            rows = []
            for a, b in in_slices(texts):
                words = Words(texts[a:b], lower=False, hashed=False)
                for k in range(b - a):
                    first, last = int(words.first[k]), int(words.last[k])
                    n = last - first
                    cover = np.zeros(n + 1, np.int64)
                    if places[a + k].is_valid:
                        at = places[a + k].values.to_numpy(zero_copy_only=False)
                        np.add.at(cover, at, 1)
                        np.add.at(cover, at + window, -1)
                    kept = np.flatnonzero(np.cumsum(cover)[:n] == 0) + first
                    if len(kept) == n:
                        left = b" ".join(words.raw[k].split())
                    else:
                        left = b" ".join([words.buf[i:j] for i, j in zip(words.start[kept].tolist(), words.stop[kept].tolist(), strict=True)])
                    rows.append((n, n - len(kept), left.decode()))
            kinds = (pa.int64(), pa.int64(), pa.string())
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_words", "n_removed", "kept"])

    return run


def _finished(window: int):
    inner = _kept(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in inner(batches):
            sha = [hashlib.sha256(t.as_py().encode()).hexdigest() for t in out.column(3)]
            yield pa.RecordBatch.from_arrays([*out.columns[:3], pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def without_repeats(docs: DataFrame, window: int = WINDOW, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept for each row of ``docs`` (doc_id, text; other columns are ignored).

    A word is removed if it is covered by a run of ``window`` words of the
    text that also begins anywhere else, in this text or another; runs are
    judged on the input.  kept: the words left, joined by one space.  Texts
    shorter than a window lose nothing.  Null text has no words and '' is
    kept.  Rows that repeat a doc_id or a text are separate places, so equal
    texts of ``window`` words or more lose all words.  A null doc_id is an id
    like others.  With ``digest``, kept_sha256 (of kept's UTF-8) stands for
    kept.
    """
    if window < 2:
        raise ValueError("a window has at least two words")
    stage = Stage(docs.sparkSession, "substring-dedup")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # a row's key: rows with equal keys are equal in id and text, and have the same windows
    keyed = docs.withColumn("key", F.xxhash64("doc_id", "text"))
    texts = keyed.select("key", "text")

    def again(windows: DataFrame, *by: str) -> DataFrame:
        """What is found more than once; written, so that joins have exchanges on both sides and a common passage's rows can be split."""
        return stage.write(windows.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1").select(*by))

    repeated = again(texts.mapInArrow(lean(_level(window, 0)), "key long, h long"), "h")
    alive = texts.mapInArrow(lean(_level(window, 0)), "key long, h long")
    done: list[DataFrame] = []
    for level in range(1, len(lengths(window)) - 1):
        if repeated.isEmpty():
            break
        grown = texts.mapInArrow(lean(_level(window, level)), "key long, below long, h long")
        alive = stage.write(grown.join(repeated.withColumnRenamed("h", "below"), "below").select("key", "h"))
        done += [repeated, alive]
        repeated = again(alive, "h")
    survivors = stage.write(alive.join(repeated, "h").groupBy("key").agg(F.collect_set("h").alias("repeated")))
    stage.drop(repeated, *done)
    packed = keyed.select("doc_id", "key", "text").mapInArrow(lean(_packed), "doc_id long, key long, packed binary")
    grown = stage.write(packed.select("key", "packed").join(survivors, "key").select("key", "packed", "repeated").mapInArrow(lean(_full(window)), "key long, place int, h long, g long"))
    stage.drop(survivors)
    full = again(grown, "h", "g")
    places = stage.write(grown.join(full, ["h", "g"]).groupBy("key").agg(F.collect_set("place").alias("places")))
    stage.drop(grown, full)
    both = packed.join(places, "key", "left").select("doc_id", "packed", "places")
    if digest:
        return both.mapInArrow(lean(_finished(window)), "doc_id long, n_words long, n_removed long, kept_sha256 string")
    return both.mapInArrow(lean(_kept(window)), "doc_id long, n_words long, n_removed long, kept string")


#: What the query gives for the table documents, in SQL.
ORACLE = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS n FROM documents
), runs AS (
  SELECT doc_id, n, md5(string_agg(word, ' ') OVER w) AS name, count(*) OVER w AS size FROM words
  WINDOW w AS (PARTITION BY doc_id ORDER BY n ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)
), repeated AS (
  SELECT doc_id, n FROM (SELECT doc_id, n, count(*) OVER (PARTITION BY name) AS c FROM runs WHERE size = 35) WHERE c > 1
), covered AS (
  SELECT w.doc_id, w.n, w.word, max(r.n) OVER (PARTITION BY w.doc_id ORDER BY w.n) >= w.n - 34 AS gone
  FROM words w LEFT JOIN repeated r ON w.doc_id = r.doc_id AND w.n = r.n
), kept AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY n) FILTER (WHERE gone IS NOT TRUE), '') AS kept
  FROM covered GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
