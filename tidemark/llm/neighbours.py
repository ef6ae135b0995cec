"""Approximate nearest neighbours by multiprobe p-stable hashing.

Nearness is the inner product, so vectors are first lifted by one coordinate:
with M the largest norm, x becomes (x / M, sqrt(1 - |x|^2 / M^2)) and a query
q becomes (q / |q|, 0); among the lifted, nearest by distance is largest by
inner product.  Each of several tables hashes the lifted vectors by projections
on normal (2-stable) directions, cut into cells.  A query looks into its own
bucket and then into perturbed ones, one cell up or down in some of the
projections, in the order of their estimated success: the probability that a
neighbour, whose projections scatter about the query's, fell there falls with
the summed squares of distances to the cells' borders.

Buckets are joined with the queries that probe them, both divided into blocks
of bounded size, and a block of vectors answers each query of a block of
queries with its k best.  Equal vectors
are one from the start, with their k + 1 smallest ids, so copies of one vector
don't fill a bucket.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Stage, uniform

K = 20
TABLES = 6
#: Width of a cell, in standard deviations of a projection.
WIDTH = 1.2
#: Vectors that the choice of the number of probes looks at, at most: those whose hashed id is smallest.
SAMPLE = 4096
#: Of these, as many ask.
ASKED = 400
#: Recall that the sample must reach; above what is asked for, as a sample's estimate scatters.
AIM = 0.95
#: Vectors of a bucket, and queries that probe it, that meet in one task, on average.
BLOCK = 4096
SEED = 97


class Index:
    """Projections for vectors of one dimension, hashing and probing."""

    def __init__(self, dim: int, hashes: int, top: float, tables: int = TABLES, width: float = WIDTH, seed: int = SEED):
        rng = np.random.Generator(np.random.PCG64(seed * 1_000_003 + dim))
        self.dim, self.hashes, self.tables, self.top = dim, hashes, tables, top
        # a projection of a lifted (unit) vector on such a direction has deviation near 1 / sqrt(dim + 1) of the direction's length
        self.directions = rng.standard_normal((tables * hashes, dim + 1))
        self.offsets = rng.uniform(0, 1, tables * hashes)
        self.width = width
        self.multiply = rng.integers(1 << 62, size=hashes, dtype=np.int64) | 1

    def _cells(self, lifted: np.ndarray) -> np.ndarray:
        return lifted @ self.directions.T / self.width + self.offsets

    def of_vectors(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables) bucket keys."""
        x = x / self.top
        last = np.sqrt(np.maximum(0.0, 1 - (x * x).sum(1)))
        cells = np.floor(self._cells(np.column_stack([x, last]))).astype(np.int64)
        return self._keys(cells.reshape(len(x), self.tables, self.hashes))

    def _keys(self, cells: np.ndarray) -> np.ndarray:
        """Keys of cells (..., hashes); a table's number is not part of them."""
        with np.errstate(over="ignore"):
            return (cells * self.multiply).sum(-1)

    def probes(self, q: np.ndarray, n: int) -> list[list[np.ndarray]]:
        """For each query and table, the keys of its n most promising buckets, best first."""
        norm = np.sqrt((q * q).sum(1, keepdims=True))
        at = self._cells(np.column_stack([q / norm, np.zeros(len(q))])).reshape(len(q), self.tables, self.hashes)
        cells = np.floor(at).astype(np.int64)
        inside = at - cells
        return [[self._keys(cells[i, t] + np.array(perturbations(inside[i, t], n))) for t in range(self.tables)] for i in range(len(q))]


def perturbations(inside: np.ndarray, n: int) -> list[tuple[int, ...]]:
    """The n perturbations of {-1, 0, 1} per projection with the least summed squares of distances to the borders crossed, least first."""
    m = len(inside)
    cost = np.concatenate([inside**2, (1 - inside) ** 2])
    order = np.argsort(cost, kind="stable")
    c = cost[order].tolist()
    out = [(0,) * m]
    heap = [(c[0], (0,))]
    while heap and len(out) < n:
        total, chosen = heapq.heappop(heap)
        last = chosen[-1]
        if len({order[j] % m for j in chosen}) == len(chosen):
            step = [0] * m
            for j in chosen:
                step[order[j] % m] = -1 if order[j] < m else 1
            out.append(tuple(step))
        if last + 1 < len(c):
            heapq.heappush(heap, (total + c[last + 1], (*chosen, last + 1)))
            heapq.heappush(heap, (total - c[last] + c[last + 1], (*chosen[:-1], last + 1)))
    return out


def choose_probes(index: Index, sample: np.ndarray, total: int, k: int, aim: float = AIM) -> int:
    """The fewest probes a table with which the sample's vectors find their neighbours within the sample.

    Of ``total`` vectors the k nearest correspond to the k * share nearest of a
    sample of that share.  A vector that asks is no neighbour of its own.
    """
    near = max(1, min(len(sample) - 1, round(k * len(sample) / max(total, 1))))
    if len(sample) < 2:
        return 1
    own = np.arange(0, len(sample), max(1, len(sample) // ASKED))
    asked = sample[own]
    scores = asked @ sample.T
    scores[np.arange(len(own)), own] = -np.inf
    truth = np.argsort(-scores, 1, kind="stable")[:, :near]
    keys = index.of_vectors(sample)
    most = 3**index.hashes
    lists = index.probes(asked, most)
    n = 1
    while n < most:
        hit = 0.0
        for i, per in enumerate(lists):
            found = np.zeros(truth.shape[1], bool)
            for t, p in enumerate(per):
                found |= np.isin(keys[truth[i], t], p[:n])
            hit += found.mean()
        if hit >= aim * len(asked):
            break
        n = max(n + 1, n * 5 // 4)
    return min(n, most)


def _scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of rows of x with q, each by the same order of additions wherever it stands."""
    return (x * q).sum(1)


def best(ids: list[np.ndarray], x: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest inner products of q with the rows of x, whose copies have the ids given: ids and scores, ties to smaller ids."""
    rough = x @ q
    if len(rough) > k:
        rough_k = np.partition(rough, len(rough) - k)[len(rough) - k]
        near = np.flatnonzero(rough >= rough_k - 1e-9 * (1 + abs(rough_k)))
    else:
        near = np.arange(len(rough))
    s = _scores(x[near], q)
    n = np.fromiter((len(ids[i]) for i in near), np.int64, len(near))
    all_ids, all_s = np.concatenate([ids[i] for i in near]), np.repeat(s, n)
    order = np.lexsort((all_ids, -all_s))[:k]
    return all_ids[order], all_s[order]


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in vectors])


_FOUND = "q long, r long, ids array<long>, scores array<double>"


def _answer(k: int):
    def run(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(queries) and len(vectors):
            x, ids = _matrix(vectors["v"]), [np.asarray(i) for i in vectors["ids"]]
            for q, r, v in zip(queries["q"], queries["r"], queries["v"], strict=True):
                found, scores = best(ids, x, np.asarray(v, np.float64), k)
                rows.append((q, r, found, scores))
        return pd.DataFrame(rows, columns=["q", "r", "ids", "scores"])

    return run


def usable(column: Column) -> Column:
    """Not null, not empty, not all zero, and every component finite."""
    fine = F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return column.isNotNull() & (F.size(column) > 0) & F.coalesce(fine, F.lit(False)) & F.exists(column, lambda c: c != 0)


def nearest(vectors: DataFrame, query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row where ``query`` holds, its k nearest found among all other rows.

    Scores are inner products in double precision of the vectors as given;
    equal scores go to the smaller id.  Vectors that are null or zero or hold
    a null or non-finite component, and rows with a null id, take no part;
    only vectors of the query's length are candidates.  A query for which
    probing found fewer than k is compared with all vectors, so with k or
    fewer others it gets them all.  Rows that repeat an id and vector count
    once for each vector.  Every row is hashed and can be found; only the
    number of probes is chosen on a sample (``SAMPLE``).
    """
    spark = vectors.sparkSession
    stage = Stage(spark, "neighbours")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), query.alias("asks")).where(F.col("id").isNotNull() & usable(F.col("v")))
    rows = rows.withColumn("q", F.xxhash64("v")).withColumn("r", F.xxhash64("v", F.lit(1))).withColumn("asks", F.coalesce("asks", F.lit(False)))
    rows = stage.write(rows.dropDuplicates(["id", "q", "r"]))
    # of equal vectors only the k + 1 smallest ids can be among any k; the limit is taken before the shuffle too
    few = rows.select("id", "q", "r", "v").withColumn("n", F.row_number().over(Window.partitionBy("q", "r").orderBy("id"))).where(F.col("n") <= k + 1)
    distinct = stage.write(few.groupBy("q", "r").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("v").alias("v")))
    asked = stage.write(rows.where("asks").groupBy("q", "r").agg(F.first("v").alias("v")))
    facts = distinct.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))).alias("top")).collect()  # a row for each length of vectors
    found = None
    for fact in facts:
        dim, n, top = fact["dim"], fact["n"], fact["top"]
        mine, ask = distinct.where(F.size("v") == dim), asked.where(F.size("v") == dim)
        index = Index(dim, max(3, min(12, round(math.log2(max(n, 2)) / 4))), top)
        sample = mine.select("v").orderBy(uniform(F.col("v"), seed=SEED), "v").limit(SAMPLE).collect()
        probes = choose_probes(index, np.array([s["v"] for s in sample]), n, k)
        part = _probed(mine, ask, index, probes, k, stage)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    merged = stage.write(_merged(found, k + 1))
    short = asked.join(merged.where(F.size("ids") > k).select("q", "r"), ["q", "r"], "left_anti")
    if not short.isEmpty():
        whole = stage.write(_merged(_exhaustive(distinct, short, k + 1), k + 1))
        merged = merged.join(whole.select("q", "r"), ["q", "r"], "left_anti").unionByName(whole)
    one = rows.where("asks").select(F.col("id").alias("query_id"), "q", "r").join(merged, ["q", "r"])
    pairs = F.slice(F.filter(F.arrays_zip("ids", "scores"), lambda p: p["ids"] != F.col("query_id")), 1, k)
    one = one.select("query_id", F.posexplode(pairs).alias("rank", "p"))
    return one.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("p.ids").alias("vec_id"), F.col("p.scores").alias("score"))


def _keyed(frame: DataFrame, index: Index, probes: int | None) -> DataFrame:
    """Rows of (q, r, v[, ids]) with the tables' keys of their buckets; of the probed ones, for queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch.column(batch.schema.get_field_index("v")).flatten()).reshape(batch.num_rows, -1)
            if probes is None:
                keys = [[[int(b)] for b in row] for row in index.of_vectors(x)]
            else:
                keys = [[[int(b) for b in dict.fromkeys(p.tolist())] for p in per] for per in index.probes(x, probes)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.list_(pa.list_(pa.int64())))], [*batch.schema.names, "keys"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frame.schema.fields)
    out = frame.mapInArrow(run, f"{kinds}, keys array<array<bigint>>")
    out = out.select(*frame.columns, F.posexplode("keys").alias("table", "key")).withColumn("key", F.explode("key"))
    return out


def _blocks(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy("table", "key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))


def _met(wanted: DataFrame, held: DataFrame, group: list[str], k: int) -> DataFrame:
    """Each block of queries (with blocks, askers: how many there are of either) against each block of vectors of its group."""
    places = [*group, "block", "asker"]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # the block of a vector and that of a query follow from their hashes
    wanted = wanted.withColumn("asker", F.pmod(F.col("r"), F.col("askers")).cast("int")).withColumn("block", every("blocks"))
    held = held.withColumn("block", F.pmod(F.col("q"), F.col("blocks")).cast("int")).withColumn("asker", every("askers"))
    return wanted.select(*places, "q", "r", "v").groupBy(*places).cogroup(held.select(*places, "ids", "v").groupBy(*places)).applyInPandas(_answer(k), _FOUND)


def _probed(vectors: DataFrame, queries: DataFrame, index: Index, probes: int, k: int, stage: Stage) -> DataFrame:
    held = _keyed(vectors.select("q", "r", "v", "ids"), index, None)
    wanted = stage.write(_keyed(queries.select("q", "r", "v"), index, probes))
    # buckets that no query probes are left out
    counts = stage.write(_blocks(held, "blocks").join(_blocks(wanted, "askers"), ["table", "key"]))
    return _met(wanted.join(counts, ["table", "key"]), held.join(counts, ["table", "key"]), ["table", "key"], k + 1)


def _exhaustive(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The queries against all vectors of their length, in blocks of both."""
    n, m = vectors.count(), queries.count()
    sized = {"dim": F.size("v"), "blocks": F.lit(max(1, math.ceil(n / BLOCK))), "askers": F.lit(max(1, math.ceil(m / BLOCK)))}
    return _met(queries.withColumns(sized), vectors.withColumns(sized), ["dim"], k)


def _merged(found: DataFrame, k: int) -> DataFrame:
    """One row for each query: its k best of all answers, an id once."""

    @F.pandas_udf("struct<ids:array<long>,scores:array<double>>")
    def merge(ids: pd.Series, scores: pd.Series) -> pd.DataFrame:
        out = []
        for i, s in zip(ids, scores, strict=True):
            i, s = np.concatenate([np.asarray(x) for x in i]), np.concatenate([np.asarray(x) for x in s])
            i, at = np.unique(i, return_index=True)
            order = np.lexsort((i, -s[at]))[:k]
            out.append((i[order], s[at][order]))
        return pd.DataFrame(out, columns=["ids", "scores"])

    # the answers of one query are as many as it has probed blocks
    grouped = found.groupBy("q", "r").agg(F.collect_list("ids").alias("ids"), F.collect_list("scores").alias("scores"))
    return grouped.select("q", "r", merge("ids", "scores").alias("m")).select("q", "r", "m.ids", "m.scores")
