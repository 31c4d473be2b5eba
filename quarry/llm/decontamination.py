"""Benchmark decontamination by greedy string tiling over shared-token seeds."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import fresh, stored, table

_TOKEN = re.compile(r"\w+")
_BASE = np.uint64(0x9E3779B97F4A7C15)

MIN_MATCH = 4
COVERAGE = 0.5
#: Test passages are taken in blocks of so many tokens, one after the other; a block is all that a task holds of the test set.
BLOCK_TOKENS = 2_000_000


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


def _rolling(ids: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hashes (mod 2^64) of all runs of k ids."""
    n = len(ids) - k + 1
    h = np.zeros(max(n, 0), dtype=np.uint64)
    for i in range(k if n > 0 else 0):
        h = h * _BASE + ids[i : i + n].astype(np.uint64)
    return h


def _runs(places: list[int], lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place, last place, diagonal) of the runs of seeds on one diagonal.

    ``lists`` holds the sorted document places of the seed at each passage place. One place's diagonals are held at a
    time, so repeated words cost time but no memory for pairs.
    """
    out, none = [], np.empty(0, dtype=np.int64)
    active, since, last = none, none, -2

    def end(which):
        out.append((since[which], np.full(int(which.sum()), last), active[which]))

    for p, at in zip(places, lists):
        d = at - p
        if p != last + 1:
            end(np.ones(len(active), dtype=bool))
            active = since = none
        spot = np.searchsorted(d, active)
        going = d[np.minimum(spot, len(d) - 1)] == active
        end(~going)
        start = np.full(len(d), p)
        start[spot[going]] = since[going]
        active, since, last = d, start, p
    end(np.ones(len(active), dtype=bool))
    return tuple(np.concatenate(x) for x in zip(*out))


class Passages:
    """One block of test passages, indexed by the hashes of their runs of ``min_match`` tokens."""

    def __init__(self, items: list[tuple[int, str | None]], min_match: int):
        self.k = min_match
        self.vocabulary: dict[str, int] = {}
        self.items, self.ids = [], []
        hashes, owners, places = [], [], []
        for item_id, text in items:
            own = np.array([self.vocabulary.setdefault(t, len(self.vocabulary) + 1) for t in tokens(text)], dtype=np.int64)
            if len(own) < min_match:  # too short to tile; see contamination()
                continue
            h = _rolling(own, min_match)
            hashes.append(h)
            owners.append(np.full(len(h), len(self.items)))
            places.append(np.arange(len(h)))
            self.items.append(item_id)
            self.ids.append(own)
        cat = lambda x, t: np.concatenate(x) if x else np.empty(0, dtype=t)
        h = cat(hashes, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hashes, self.owners, self.places = h[order], cat(owners, np.int64)[order], cat(places, np.int64)[order]

    def tile(self, item: int, doc: np.ndarray, first: np.ndarray, last: np.ndarray, diagonal: np.ndarray) -> list[tuple[int, int, int]]:
        """Tiles (start in document, start in passage, length) of one pair, from its runs of seeds, longest first.

        Runs are cut where a hash agreed and the tokens do not. The longest match whose tokens are free is marked; one
        that is partly marked is cut to its free runs of k tokens or more, which wait their turn. Ties: smaller place in
        the passage, then in the document. Done when the passage has no k free tokens.
        """
        k, own, heap, tiles = self.k, self.ids[item], [], []

        def push(i: int, j: int, good: np.ndarray) -> None:
            turn = np.flatnonzero(np.diff(np.concatenate(([0], good.view(np.int8), [0]))))
            for a, b in turn.reshape(-1, 2).tolist():
                if b - a >= k:
                    heapq.heappush(heap, (a - b, i + a, j + a))

        for i, e, d in zip(first.tolist(), last.tolist(), diagonal.tolist()):
            size = e - i + k
            push(i, i + d, doc[i + d : i + d + size] == own[i : i + size])
        free_item, free_doc, left = np.ones(len(own), dtype=bool), np.ones(len(doc), dtype=bool), len(own)
        while heap and left >= k:
            size, i, j = heapq.heappop(heap)
            size = -size
            free = free_item[i : i + size] & free_doc[j : j + size]
            if free.all():
                free_item[i : i + size] = free_doc[j : j + size] = False
                left -= size
                tiles.append((j, i, size))
            else:
                push(i, j, free)
        return tiles

    def matches(self, text: str | None, coverage: float = 0.0) -> Iterator[tuple[int, float, list[tuple[int, int, int]]]]:
        """(item_id, covered share, tiles) of each passage that shares seeds with the text and is covered that far."""
        get = self.vocabulary.get
        doc = np.array([get(t, 0) for t in tokens(text)], dtype=np.int64)
        if len(doc) < self.k or not len(self.hashes):
            return
        h = _rolling(doc, self.k)
        known = np.concatenate(([0], np.cumsum(doc == 0)))
        where = np.flatnonzero(known[self.k :] == known[: -self.k])
        where = where[self.hashes[np.minimum(np.searchsorted(self.hashes, h[where]), len(self.hashes) - 1)] == h[where]]
        if not len(where):
            return
        # each seed of the document once: its places there, and the passages' places that share it
        seeds, which = np.unique(h[where], return_inverse=True)
        at_doc = np.split(where[np.argsort(which, kind="stable")], np.cumsum(np.bincount(which))[:-1])
        lo, hi = np.searchsorted(self.hashes, seeds, "left"), np.searchsorted(self.hashes, seeds, "right")
        n = hi - lo
        entry = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        seed = np.repeat(np.arange(len(seeds)), n)
        order = np.lexsort((self.places[entry], self.owners[entry]))
        owner, place, seed = self.owners[entry][order], self.places[entry][order], seed[order]
        cut = np.flatnonzero(np.diff(owner)) + 1
        for a, b in zip(np.append(0, cut).tolist(), np.append(cut, len(owner)).tolist()):
            item = int(owner[a])
            if (b - a) * self.k < coverage * len(self.ids[item]):  # the tiles cannot cover more than that
                continue
            tiles = self.tile(item, doc, *_runs(place[a:b].tolist(), [at_doc[x] for x in seed[a:b].tolist()]))
            covered = sum(t[2] for t in tiles) / len(self.ids[item])
            if tiles and covered >= coverage:
                yield self.items[item], covered, tiles


def _blocks(benchmark: DataFrame, block_tokens: int) -> Iterator[list[tuple[int, str | None]]]:
    """The test set, streamed to the driver partition by partition and cut to blocks of bounded size."""
    block, size = [], 0
    for row in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        block.append((row["item_id"], row["text"]))
        size += len(row["text"]) // 4 + 1
        if size >= block_tokens:
            yield block
            block, size = [], 0
    if block:
        yield block


def contamination(documents: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, text: str = "text", output: str = "contamination", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``documents`` with an array of the test passages they hold: item_id, coverage and tiles, by item_id.

    A passage counts if tiles of ``min_match`` tokens or more, in any order, cover at least ``coverage`` of its tokens
    (tokens: lower-cased runs of letters, digits and underscores). Each document is matched where it lies: the test set
    goes to the tasks in blocks of bounded size, so nothing is shuffled. A second block starts when the first one's
    result is stored, so several blocks need the memory of one and a pass each. Passages of fewer than ``min_match`` tokens,
    null passages and null or short documents match nothing; an empty test set marks nothing; repeated passages are
    reported each; a document that only quotes a few words of a passage stays below ``coverage``. Other columns are
    kept, and one called ``output`` is replaced.
    """
    kind = "array<struct<item_id: long, coverage: double, tiles: array<struct<document: int, passage: int, length: int>>>>"
    out = documents.withColumn(output, F.array().cast(kind))

    def finder(sent):
        @F.pandas_udf(kind)
        def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            passages = Passages(sent.value, min_match)
            for t in batches:
                yield pd.Series([
                    [{"item_id": i, "coverage": c, "tiles": [{"document": d, "passage": p, "length": n} for d, p, n in tiles]} for i, c, tiles in passages.matches(x, coverage)]
                    for x in t
                ])

        return find

    sent = None
    for block in _blocks(benchmark, block_tokens):
        if sent is not None:
            out = stored(out, "contamination")
            sent.unpersist()
        sent = documents.sparkSession.sparkContext.broadcast(block)
        out = out.withColumn(output, F.array_sort(F.concat(output, finder(sent)(F.col(text).cast("string")))))
    return out


def decontaminate(documents: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE) -> DataFrame:
    """The documents that hold no test passage, with their columns as they were."""
    name = fresh(documents, "found")
    found = contamination(documents, benchmark, min_match, coverage, output=name)
    return found.where(F.size(name) == 0).drop(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    items = F.col("contamination")
    return found.select(
        "doc_id", (F.size(items) > 0).alias("contaminated"), F.transform(items, lambda x: x["item_id"]).alias("item_ids"),
        F.coalesce(F.array_max(F.transform(items, lambda x: x["coverage"])), F.lit(0.0)).alias("coverage"),
    )


QUERIES = {"op1_decontamination": op1_decontamination}
