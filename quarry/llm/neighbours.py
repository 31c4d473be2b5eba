"""Approximate nearest neighbours by an inverted multi-index over two vector halves."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import stored, table

K = 10
#: Centroids of each half, and vectors that they are fitted on.
CENTROIDS = 1024
FIT_ROWS = 20_000
#: How far a query walks is measured: so many sampled vectors are searched by brute force, and the walk goes as far as it
#: takes to meet this share of their neighbours.
CALIBRATION, RECALL = 256, 0.96
#: Vectors of a list, and queries, that meet in one task at most.
LIST_ROWS, QUERY_ROWS = 4_096, 4_096


def centroids(x: np.ndarray, k: int, rounds: int = 10, seed: int = 0) -> np.ndarray:
    """k-means with k-means++ starts; fewer centroids if there are fewer distinct vectors."""
    x = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    if len(x) <= k:
        return x
    c = np.empty((k, x.shape[1]))
    c[0] = x[rng.integers(len(x))]
    near = ((x - c[0]) ** 2).sum(axis=1)
    for i in range(1, k):
        c[i] = x[rng.choice(len(x), p=near / near.sum())]
        near = np.minimum(near, ((x - c[i]) ** 2).sum(axis=1))
    for _ in range(rounds):
        own = nearest_centroid(x, c)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances, for ranking centroids only."""
    return (x**2).sum(axis=1)[:, None] - 2 * x @ c.T + (c**2).sum(axis=1)[None]


def nearest_centroid(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([distances(x[i : i + 4096], c).argmin(axis=1) for i in range(0, len(x), 4096)] or [np.empty(0, dtype=np.int64)])


@dataclass
class MultiIndex:
    """Codebooks of the two halves, and the lists of their pairs that hold vectors.

    ``cells`` are those pairs in order (left * number of right centroids + right), ``sizes`` the lengths of their lists.
    """

    left: np.ndarray
    right: np.ndarray
    cells: np.ndarray
    sizes: np.ndarray

    def __post_init__(self):
        self.lefts, self.rights = np.divmod(self.cells, len(self.right))
        self.first = np.searchsorted(self.lefts, np.arange(len(self.left) + 1))

    def cell(self, x: np.ndarray) -> np.ndarray:
        h = self.left.shape[1]
        return nearest_centroid(x[:, :h], self.left) * len(self.right) + nearest_centroid(x[:, h:], self.right)

    def sums(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = self.left.shape[1]
        return distances(query[None, :h], self.left)[0], distances(query[None, h:], self.right)[0]

    def walk(self, query: np.ndarray, candidates: int) -> np.ndarray:
        """Places in ``cells`` of the pairs by the sum of their halves' distances, until their lists hold ``candidates`` vectors.

        The heap holds the next pair of each left centroid; a left centroid's pairs are sorted when its first one comes.
        """
        a, b = self.sums(query)
        least = np.minimum.reduceat(b[self.rights], np.minimum(self.first[:-1], len(self.cells) - 1))
        heap = [(a[i] + least[i], i, 0) for i in np.flatnonzero(np.diff(self.first)).tolist()]
        heapq.heapify(heap)
        rows, out, n = {}, [], 0
        while heap and n < candidates:
            _, i, at = heap[0]
            if i not in rows:
                start, end = self.first[i], self.first[i + 1]
                order = b[self.rights[start:end]].argsort(kind="stable")
                rows[i] = (order + start).tolist(), (a[i] + b[self.rights[start:end]][order]).tolist()
            places, sums = rows[i]
            out.append(places[at])
            n += int(self.sizes[places[at]])
            if at + 1 < len(places):
                heapq.heapreplace(heap, (sums[at + 1], i, at + 1))
            else:
                heapq.heappop(heap)
        return np.array(out, dtype=np.int64)

    def needed(self, query: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """How many vectors a walk has read when it has read each of the given pairs."""
        a, b = self.sums(query)
        sums = a[self.lefts] + b[self.rights]
        order = sums.argsort(kind="stable")
        read = np.empty(len(sums), dtype=np.int64)
        read[order] = np.cumsum(self.sizes[order])
        return read[np.searchsorted(self.cells, cells)]


def usable(embeddings: DataFrame, id_: str, vector: str) -> DataFrame:
    """(vec_id, v) of rows with an id and a vector that is neither null, empty, zero nor holds null or non-finite numbers.

    v is in double precision; the commonest length wins over others, as vectors of unlike length have no distance.
    """
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    v = F.col("v")
    rows = embeddings.select(F.col(id_).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0))


def _matrix(v: pd.Series) -> np.ndarray:
    return np.array(v.tolist(), dtype=np.float64)


def one_vector(rows: DataFrame) -> DataFrame:
    """(vec_id, v) with one row per id: of a repeated id the smallest vector. Only repeated ids are shuffled with their vectors."""
    repeated = stored(rows.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id"), "repeated-ids")
    return rows.join(repeated, "vec_id", "left_anti").unionByName(rows.join(repeated, "vec_id").groupBy("vec_id").agg(F.min("v").alias("v")))


def walk_length(entries: DataFrame, model: MultiIndex, k: int, calibration: int, recall: float) -> int:
    """How many vectors a walk has to read so that ``calibration`` sampled vectors meet ``recall`` of their ``k`` nearest.

    The sample's neighbours are found by brute force: each task keeps its best k of every sampled vector.
    """
    sample = entries.orderBy(F.xxhash64("v", F.lit("calibration"))).limit(calibration).select("v").toPandas()
    q = _matrix(sample["v"])

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d, cells = np.full((len(q), k), np.inf), np.zeros((len(q), k), dtype=np.int64)
        for b in batches:
            if not len(b):
                continue
            x = _matrix(b["v"])
            own = distances(q, x)
            own[own < 1e-9] = np.inf  # the vector itself
            all_, places = np.hstack([d, own]), np.hstack([cells, np.broadcast_to(b["cell"].to_numpy(), own.shape)])
            at = np.argpartition(all_, k - 1, axis=1)[:, :k]
            d, cells = np.take_along_axis(all_, at, axis=1), np.take_along_axis(places, at, axis=1)
        row, col = np.nonzero(np.isfinite(d))
        yield pd.DataFrame({"q": row.astype(np.int32), "d": d[row, col], "cell": cells[row, col]})

    near = entries.select("v", "cell").mapInPandas(best, "q int, d double, cell long")
    top = F.slice(F.array_sort(F.collect_list(F.struct("d", "cell"))), 1, k)
    found = near.groupBy("q").agg(top.alias("near")).collect()  # a row per sampled vector
    reads = [n for r in found for n in model.needed(q[r["q"]], np.array([x["cell"] for x in r["near"]], dtype=np.int64))]
    return int(np.quantile(reads, recall, method="higher")) if reads else 1


def search(embeddings: DataFrame, queries: DataFrame, k: int = K, n_centroids: int = CENTROIDS, recall: float = RECALL, fit_rows: int = FIT_ROWS, calibration: int = CALIBRATION, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every query, by Euclidean distance, ties to smaller ids.

    ``queries`` has rows like ``embeddings``; a row never finds its own id. Codebooks are fitted on at most ``fit_rows``
    vectors of smallest hash; every vector is indexed. How many vectors a query reads is measured (``walk_length``), so it
    follows the data at every size. Equal vectors stand in the index once, with as many of their smallest ids as an answer
    can hold, so copies of one vector cost nothing. Lists are packed by left centroid to blocks of at most ``LIST_ROWS``
    vectors, queries to batches; a block and a batch meet in a task and give each query its best k, and those are merged.
    Unusable vectors (see ``usable``) take no part; of an id with several vectors the smallest counts, as a candidate and as
    a query; fewer than k candidates: all. The commonest vector length is searched, as vectors of unlike length have no
    distance. Other columns are not returned.
    """
    rows = usable(embeddings, id_, vector)
    size = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    spark = embeddings.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    if size is None:
        return spark.createDataFrame([], out)
    d = size["d"]
    zero = F.transform("v", lambda x: x + F.lit(0.0))  # -0.0 becomes 0.0
    if d == 1:  # a second half of zeros
        zero, d = F.concat(zero, F.array(F.lit(0.0))), 2
    plain = lambda df: one_vector(df.where(F.size("v") == size["d"]).select("vec_id", zero.alias("v")))
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    least = plain(rows).withColumn("place", place).where(F.col("place") <= k + 1)  # a group limit: k + 1 rows of a vector leave a task
    distinct = stored(least.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "vectors")
    sample = distinct.orderBy(F.xxhash64("v"), F.col("ids")[0]).limit(fit_rows).select("v").toPandas()
    x = _matrix(sample["v"])
    left, right = centroids(x[:, : d // 2], n_centroids), centroids(x[:, d // 2 :], n_centroids)
    book = MultiIndex(left, right, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))
    cell_of = F.pandas_udf(lambda v: pd.Series(book.cell(_matrix(v)) if len(v) else [], dtype="int64"), "long")
    entries = stored(distinct.withColumn("cell", cell_of("v")), "entries")
    counted = entries.groupBy("cell").agg(F.count("*").alias("n")).toPandas().sort_values("cell")  # one row per pair of centroids at most
    model = MultiIndex(left, right, counted["cell"].to_numpy(dtype=np.int64), counted["n"].to_numpy(dtype=np.int64))
    enough = walk_length(entries, model, k, calibration, recall)

    held = np.bincount(model.lefts, weights=model.sizes, minlength=len(left)).astype(np.int64)
    block = np.zeros(len(left), dtype=np.int64)  # neighbouring left centroids share a block until it is full
    start, room = 0, 0
    for i, n in enumerate(held.tolist()):
        if n > room and room < LIST_ROWS:
            start, room = i, LIST_ROWS
        block[i], room = start, room - n
    sent = spark.sparkContext.broadcast((model, block))

    @F.pandas_udf("array<struct<block: int, cells: array<int>>>")
    def walk(v: pd.Series) -> pd.Series:
        model, block = sent.value
        out = []
        for q in v:
            at = model.walk(np.asarray(q, dtype=np.float64), enough)
            by = block[model.lefts[at]]
            order = by.argsort(kind="stable")
            cut = np.flatnonzero(np.diff(by[order])) + 1
            out.append([{"block": int(by[part[0]]), "cells": model.cells[at[part]].tolist()} for part in np.split(order, cut) if len(part)])
        return pd.Series(out)

    asked = plain(usable(queries, id_, vector)).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    probes = stored(asked.withColumn("p", F.explode(walk("q"))).select("query_id", "q", "p.block", "p.cells"), "probes")
    asks = {r["block"]: r["m"] for r in probes.groupBy("block").agg(F.count("*").alias("m")).collect()}  # one row per left centroid at most
    full = np.bincount(block, weights=held, minlength=len(left)).astype(np.int64)
    plan = [(a, -(-int(full[a]) // LIST_ROWS), -(-m // QUERY_ROWS)) for a, m in asks.items()]
    dealt = F.broadcast(spark.createDataFrame(plan or [(-1, 1, 1)], "block int, lists int, batches int"))  # one row per left centroid at most
    owner = F.broadcast(spark.createDataFrame([(i, int(b)) for i, b in enumerate(block)], "left int, block int"))  # likewise
    lists = entries.withColumn("left", F.floor(F.col("cell") / len(right)).cast("int")).join(owner, "left").join(dealt, "block").withColumn("list", F.pmod(F.xxhash64(F.col("ids")[0]), F.col("lists")).cast("int"))
    lists = lists.withColumn("batch", F.explode(F.sequence(F.lit(0), F.col("batches") - 1))).select("block", "list", "batch", "cell", "ids", "v")
    batches = probes.join(dealt, "block").withColumn("batch", F.pmod(F.xxhash64("query_id"), F.col("batches")).cast("int"))
    batches = batches.withColumn("list", F.explode(F.sequence(F.lit(0), F.col("lists") - 1))).select("block", "list", "batch", "query_id", "q", "cells")

    def rerank(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return nearest(a, b, k)

    by = ["block", "list", "batch"]
    found = lists.groupBy(by).cogroup(batches.groupBy(by)).applyInPandas(rerank, "query_id long, vec_id long, score double")
    return _best(found, k)


def nearest(entries: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """The best k ids for each query (query_id, q, cells) among the entries (cell, ids, v) of its cells.

    Distances are exact, in double precision; ties go to smaller ids.
    """
    rows = []
    if len(entries) and len(queries):
        x, q, ids = _matrix(entries["v"]), _matrix(queries["q"]), entries["ids"].tolist()
        known, own = np.unique(entries["cell"].to_numpy(), return_inverse=True)
        for i, query, cells in zip(queries["query_id"].tolist(), q, queries["cells"]):
            place = np.minimum(np.searchsorted(known, cells), len(known) - 1)
            asked = np.zeros(len(known), dtype=bool)
            asked[place[known[place] == cells]] = True
            at = np.flatnonzero(asked[own])
            if not len(at):
                continue
            s = np.sqrt(((x[at] - query) ** 2).sum(axis=1))
            # each entry has an id other than the query's, but for the query's own vector
            cut = np.partition(s, k)[k] if len(s) > k else np.inf
            near = sorted((float(s[e]), int(v)) for e in np.flatnonzero(s <= cut) for v in ids[at[e]] if v != i)
            rows += [(i, v, t) for t, v in near[:k]]
    return pd.DataFrame({"query_id": pd.Series([r[0] for r in rows], dtype="int64"), "vec_id": pd.Series([r[1] for r in rows], dtype="int64"), "score": pd.Series([r[2] for r in rows], dtype="float64")})


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query: at most k rows for each list that it met, sorted in one array per query."""
    near = F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, k)
    ranked = found.groupBy("query_id").agg(near.alias("near")).select("query_id", F.posexplode("near").alias("p", "x"))
    return ranked.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(embeddings, embeddings.where("vec_id % 100 = 0"))


QUERIES = {"op5_neighbours": op5_neighbours}
