"""Near-duplicates by Jaccard similarity: SimHash links give the candidates, the texts' shingle sets decide.

The pipeline's near-duplicate stage, with wide fingerprints (see the README). No MinHash is left here but the module's name.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import stored, whole_rows
from quarry.llm.components import components
from quarry.llm.simhash import wide_fingerprint, wide_links

SHINGLE = 5
SIMILARITY = 0.8
SEED = 42
#: All pairs are candidates in a group of linked fingerprints of up to so many texts; larger crowds are compared in blocks.
CROWD = 32
#: Shingles in a block of a crowd, which one task holds.
BLOCK = 1 << 18
#: Texts are preselected by so many buckets of their hash, which bounds the broadcast.
BUCKETS = 1 << 20


def words(text: str | None) -> list[bytes]:
    """As in SimHash: only A-Z change case, only ASCII space splits."""
    return (text or "").encode("utf-8", "replace").lower().split()


def _hashes(w: list[bytes], shingle: int) -> np.ndarray:
    """Sorted distinct XXH64 of the runs of ``shingle`` words; fewer words are one run, no words none."""
    import xxhash

    runs = map(b" ".join, zip(*(w[i:] for i in range(shingle)))) if len(w) >= shingle else [b" ".join(w)] if w else []
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(x, SEED) for x in runs), dtype=np.uint64))


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The hashed shingle set of a whole text, as sorted signed longs."""
    return np.sort(_hashes(words(text), shingle).astype(np.int64))


def signature(text: str | None, shingle: int = SHINGLE) -> tuple[int, int, bytes]:
    """(id of the word sequence, number of shingles, wide fingerprint; none without words) of a whole text."""
    import xxhash

    w = words(text)
    id_ = int(np.uint64(xxhash.xxh64_intdigest(b" ".join(w), SEED)).astype(np.int64))
    h = _hashes(w, shingle)
    return id_, len(h), wide_fingerprint(h) if len(h) else b""


class Block:
    """Shingle sets side by side, for the overlap of one set with all of them at once."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)[:-1]))
        self.values, self.place = np.unique(np.concatenate(sets), return_inverse=True)

    def near(self, s: np.ndarray, similarity: float) -> np.ndarray:
        """Which sets are similar to ``s``; none is empty."""
        at = np.minimum(np.searchsorted(self.values, s), len(self.values) - 1)
        mark = np.zeros(len(self.values), dtype=np.int32)
        mark[at[self.values[at] == s]] = 1
        both = np.add.reduceat(mark[self.place], self.starts)
        return np.flatnonzero(both >= similarity * (self.sizes + len(s) - both))


def forest(ids: list[int], sets: list[np.ndarray], similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links that connect whatever all similar pairs connect, fewer than there are texts.

    A text is compared with all others unless it is in the largest group when its turn comes: pairs inside a group add
    nothing, and every other pair has an end outside the largest one.
    """
    block, out, n = Block(sets), [], len(ids)
    group, count, asked = np.arange(n), np.ones(n, dtype=np.int64), np.zeros(n, dtype=bool)
    while len(left := np.flatnonzero(~asked & (group != count.argmax()))):
        x = left[0]
        asked[x] = True
        for y in block.near(sets[x], similarity):
            a, b = group[x], group[y]
            if a != b:
                out.append((ids[x], ids[y]))
                group[group == b] = a
                count[a], count[b] = count[a] + count[b], 0
    return out


def _sets(table: pa.Table) -> list[np.ndarray]:
    lists = table.column("set").combine_chunks()
    if not len(lists):
        return []
    ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]


def _link_table(links: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})


def _crowd_links(members: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """Links across the blocks of crowds that have several.

    Texts outside a crowd's largest group are asked, in batches of about a block, of every block of the crowd; groups are
    known by their roots, and a batch gives one link for every two groups that it joins.
    """
    members = members.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    members = stored(members, "near-members")
    largest = members.groupBy("band", "root").agg(F.count("*").alias("c")).groupBy("band").agg(F.max(F.struct("c", "root")).alias("most"))
    rest = members.join(largest, "band").where("root <> most.root").select("band", "id", "n", "blocks", "root", "set")
    dealt = stored(rest.groupBy("band").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("batches")), "near-batches")
    asked = rest.join(dealt, "band").withColumn("batch", F.pmod(F.xxhash64("id", F.lit(1)), F.col("batches")).cast("int"))
    asked = asked.select("band", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "batch", "id", "root", "set").toDF("band", "block", "batch", "id", "root", "set")
    blocks = members.join(dealt, "band").select("band", "block", F.explode(F.sequence(F.lit(0), F.col("batches") - 1)).alias("batch"), "id", "root", "set")

    def links(block: pa.Table, batch: pa.Table) -> pa.Table:
        out, joined = [], {}

        def root(x):
            while x in joined:
                x = joined[x]
            return x

        if len(block) and len(batch):
            held, sets, ids, roots_ = Block(_sets(block)), _sets(batch), block.column("id").to_pylist(), block.column("root").to_pylist()
            for s, id_, own in zip(sets, batch.column("id").to_pylist(), batch.column("root").to_pylist()):
                for y in held.near(s, similarity):
                    a, b = root(own), root(roots_[y])
                    if a != b:
                        joined[a] = b
                        out.append((id_, ids[y]))
        return _link_table(out)

    by = ["band", "block", "batch"]
    return blocks.groupBy(by).cogroup(asked.groupBy(by)).applyInArrow(links, "a long, b long")


def _roots(first: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(node, root) of all texts that are similar to another.

    Texts whose fingerprints are linked, directly or not, are a band; only they are compared. A band of up to ``CROWD``
    texts gives all its pairs whose sizes allow the similarity, each pair once. A crowd is dealt to blocks of about
    ``BLOCK`` shingles, each with the crowd's smallest text; a block's task links its texts
    by ``forest``. Only for crowds of several blocks do texts that stay outside the largest group go to the other blocks.
    """
    fits = lambda n, m: F.least(n, m) >= similarity * F.greatest(n, m)
    bands = components(wide_links(first.where("n > 0").select("id", "n", "print"), similarity)).toDF("id", "band")
    keyed = first.select("id", "n").join(bands, "id")
    shared = keyed.groupBy("band").agg(F.count("*").alias("size"), F.sum("n").alias("total"), F.min(F.struct("id", "n")).alias("low")).where("size > 1")
    shared = stored(shared, "near-bands")
    few = keyed.join(shared.where(F.col("size") <= CROWD).select("band"), "band").groupBy("band").agg(F.array_sort(F.collect_list(F.struct("id", "n"))).alias("m"))
    few = few.select(F.posexplode("m").alias("i", "x"), "m").select("x", F.explode(F.slice("m", F.col("i") + 2, CROWD)).alias("y"))
    pairs = stored(few.where(fits(F.col("x.n"), F.col("y.n"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct(), "near-pairs")
    crowded = shared.where(F.col("size") > CROWD).select("band", F.ceil(F.col("total") / BLOCK).cast("int").alias("blocks"), "low")
    block = lambda id_: F.pmod(F.xxhash64(id_), F.col("blocks")).cast("int")
    crowd = keyed.join(crowded, "band").select("band", "id", "n", "blocks", block("id").alias("block"))
    guests = crowded.where("blocks > 1").select("band", "low.id", "low.n", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).where(F.col("block") != block("id"))
    crowd = stored(crowd.unionByName(guests), "near-crowds")

    needed = pairs.select(F.explode(F.array("a", "b")).alias("id")).unionByName(crowd.select("id")).distinct()
    needed = stored(needed.join(first.select("id", "place.key"), "id"), "near-needed")
    bucket = F.pmod(F.col("key.h"), F.lit(BUCKETS)).cast("int").alias("bucket")
    wanted = F.broadcast(needed.select(bucket).distinct())  # BUCKETS rows at most
    make = F.pandas_udf(lambda t: pd.Series([shingles(x, shingle) for x in t]), "array<long>")
    held = texts.withColumn("bucket", bucket).join(wanted, "bucket", "left_semi").select("key", make("text").alias("set"))
    sets = stored(held.groupBy("key").agg(F.first("set").alias("set")).join(needed, "key").select("id", "set"), "near-sets")

    side = lambda name: sets.select(F.col("id").alias(name), F.col("set").alias(f"{name}_set"))
    both = F.size(F.array_intersect("a_set", "b_set"))
    close = both >= similarity * (F.size("a_set") + F.size("b_set") - both)
    links = pairs.join(side("a"), "a").join(side("b"), "b").where(close).select("a", "b")
    crowd = crowd.join(sets, "id")
    trees = crowd.select("band", "block", "id", "set").groupBy("band", "block").applyInArrow(
        lambda t: _link_table(forest(t.column("id").to_pylist(), _sets(t), similarity)), "a long, b long"
    )
    links = stored(links.unionByName(trees), "near-links")
    roots = components(links)
    many = crowd.where("blocks > 1")
    if not crowded.where("blocks > 1").limit(1).count():
        return roots
    return components(links.unionByName(_crowd_links(many, roots, similarity)))


def deduplicate(documents: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, text: str = "text") -> DataFrame:
    """One row of each group of similar texts, with its columns as they were: that of the smallest doc_id.

    A group is what can be reached over pairs of ``similarity`` or more (Jaccard, sets of ``shingle`` words); texts of the
    same words are one, and so are all without words. Null ids come last, smaller text hashes first; of rows alike in
    id and text one stays. Rows alike are brought down to one before the shuffle. Empty table: no rows.
    """
    body = F.col(text).cast("string")
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("string").alias("same"), F.xxhash64(body).alias("h"))
    place = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), key.alias("key"))
    make = F.pandas_udf(lambda t: pd.DataFrame([signature(x, shingle) for x in t], columns=["id", "n", "print"]), "id long, n int, print binary")
    signed = documents.select(place.alias("place"), make(body).alias("s")).select("place", "s.*")
    first = stored(signed.groupBy("id").agg(F.min("place").alias("place"), F.first("n").alias("n"), F.first("print").alias("print")), "near-first")
    roots = _roots(first, documents.select(key.alias("key"), body.alias("text")), shingle, similarity)
    rooted = first.join(roots, first["id"] == roots["node"], "left").select("place", F.coalesce("root", "id").alias("root"))
    keepers = rooted.groupBy("root").agg(F.min("place").alias("place")).select("place.key")
    rows = documents.select(whole_rows(documents).alias("row"), key.alias("key"))
    sortable = [F.col(f"row.`{f.name}`") for f in documents.schema if not re.search("map<|variant|void", f.dataType.simpleString())]
    alike = rows.groupBy("key").agg(F.min_by("row", F.struct(*sortable)).alias("row"))
    return alike.join(keepers, "key", "left_semi").select("row.*")
