"""SimHash near-duplicates: fingerprints, links by shared blocks, groups; wide fingerprints for looser similarities."""

from __future__ import annotations

import math
import re
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import stored, table, whole_rows
from quarry.llm.components import components

SHINGLE = 3
DISTANCE = 2
SEED = 42
#: The 64 bits in five blocks; two fingerprints that differ in at most two bits agree in three blocks or more.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))


def _mask(start: int, size: int) -> int:
    return ((1 << size) - 1) << start


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: (mask of the shared bits, mask of the free bits) of every choice of three blocks.
KEYS = [(m := sum(_mask(*b) for b in three), ~m & ((1 << 64) - 1)) for three in combinations(BLOCKS, 3)]

_ODD = np.uint64(0x0101010101010101)

#: Bits of a wide fingerprint. Sets of Jaccard 0.8 have a cosine of 0.889 or more, so a bit differs with 0.1515 (0.158 in the smallest sets).
WIDE = 512
WIDE_AGREE = 0.842
#: Pairs are linked up to so many differing bits, of all and of the first 64: at 0.153 a bit, more differ in 4e-6 of such pairs.
WIDE_DISTANCE, FIRST_DISTANCE = 120, 24
#: A pair of Jaccard 0.8 agrees in no block with at most this probability.
MISS = 5e-5
#: Blocks are as wide as it takes for a value to gather about so many fingerprints, all of which are compared.
GATHER = 4096
#: Values that gather more are dealt to parts of about so many, and every two parts meet in a task.
PART = 8192

_RNG = np.random.default_rng(SEED)
_MULTIPLY = _RNG.integers(0, 1 << 63, WIDE // 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_EVEN = np.uint64(0x00FF00FF00FF00FF)


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits (from the lowest) is set. Eight counters share a word, so 255 words add up at once."""
    out = np.zeros((8, 8), dtype=np.int64)
    for i in range(0, len(h), 255):
        part = h[i : i + 255]
        for j in range(8):
            lanes = ((part >> np.uint64(j)) & _ODD).sum(dtype=np.uint64)
            out[:, j] += np.frombuffer(int(lanes).to_bytes(8, "little"), dtype=np.uint8)
    return out.reshape(64)


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of a whole text; 0 for texts without words (null included)."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: only A-Z change, only ASCII space splits
    if not words:
        return 0
    if len(words) < shingle:
        runs = [b" ".join(words)]
    else:
        runs = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(x, seed) for x in runs), dtype=np.uint64, count=max(1, len(words) - shingle + 1))
    set_ = bit_counts(h) * 2 > len(h)
    return int.from_bytes(np.packbits(set_, bitorder="little").tobytes(), "little")


def fingerprints(documents: DataFrame, shingle: int = SHINGLE, seed: int = SEED, text: str = "text", output: str = "fingerprint") -> DataFrame:
    """``documents`` with the fingerprint as a signed long; other columns kept, one called ``output`` replaced."""
    make = F.pandas_udf(lambda t: pd.Series([_signed(fingerprint(x, shingle, seed)) for x in t], dtype="int64"), "long")
    return documents.withColumn(output, make(F.col(text).cast("string")))


def links(prints: DataFrame, column: str = "fingerprint") -> DataFrame:
    """(a, b): links that connect all pairs of distinct fingerprints with at most two differing bits, and no others.

    Every fingerprint goes under its ten keys of three blocks. A key with two fingerprints is a candidate pair. Under a
    key with more, pairs are not formed: two of its fingerprints are close exactly if they are equal after at most one
    of the free bits is flipped in each, so each goes under its flipped values, of which none can gather more than 65
    fingerprints, and is a candidate with the smallest there. So crowded keys cost 28 rows a fingerprint, not pairs. The
    Hamming distance of every candidate is verified.
    """
    f = F.col("f")
    distinct = prints.select(F.col(column).alias("f")).where("f IS NOT NULL").distinct()
    keyed = distinct.select("f", F.posexplode(F.array(*[f.bitwiseAND(F.lit(_signed(k))) for k, _ in KEYS])).alias("k", "key"))
    shared = keyed.groupBy("k", "key").agg(F.count("*").alias("n"), F.min("f").alias("a"), F.max("f").alias("b")).where("n > 1")
    shared = stored(shared, "simhash-keys")
    pairs = shared.where("n = 2").select("a", "b")
    crowded = shared.where("n > 2").select("k", "key")
    free = F.element_at(F.array(*[F.lit(_signed(m)) for _, m in KEYS]), F.col("k") + 1)
    members = keyed.join(crowded, ["k", "key"]).groupBy("f").agg(F.bit_or(free).alias("free"))
    flips = F.concat(F.array(f), F.filter(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(F.getbit(F.col("free"), i) == 1, f.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))), lambda x: x.isNotNull()))
    meeting = members.select("f", F.explode(flips).alias("value")).groupBy("value").agg(F.array_sort(F.collect_set("f")).alias("fs")).where(F.size("fs") > 1)
    stars = meeting.select(F.col("fs")[0].alias("a"), F.explode(F.slice("fs", 2, 65)).alias("b"))
    return pairs.unionByName(stars).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)


def wide_fingerprint(h: np.ndarray) -> bytes:
    """The 512-bit SimHash of a set of hashed shingles (unsigned, not empty), as bytes of eight bits from the lowest.

    A shingle votes on a bit with a byte of its remixed hash, not with one bit: even votes of few shingles hardly ever tie.
    Sums of 256 votes fit in the 16-bit lanes of a word.
    """
    even, odd = np.zeros((2, WIDE // 8, 4), dtype=np.int64)
    for i in range(0, len(h), 256):
        x = h[i : i + 256, None] * _MULTIPLY
        x ^= x >> np.uint64(32)
        x *= _MIX
        x ^= x >> np.uint64(29)
        even += (x & _EVEN).sum(axis=0).view(np.uint16).reshape(-1, 4)
        odd += ((x >> np.uint64(8)) & _EVEN).sum(axis=0).view(np.uint16).reshape(-1, 4)
    votes = np.stack([even, odd], axis=2).reshape(WIDE)
    return np.packbits(votes * 2 > 255 * len(h), bitorder="little").tobytes()


def wide_blocks(count: int) -> list[np.ndarray]:
    """The bits of each block: enough of them that a value gathers about ``GATHER`` of ``count`` fingerprints, and enough blocks for ``MISS``."""
    size = max(0, math.ceil(math.log2(max(1, count) / GATHER)))
    blocks = math.ceil(math.log(MISS) / math.log(1 - WIDE_AGREE**size)) if size else 1
    if size * blocks > WIDE:  # blocks share bits, so they fail together: the loss is that over all numbers of differing bits
        differ = np.array([math.comb(WIDE, d) * (1 - WIDE_AGREE) ** d * WIDE_AGREE ** (WIDE - d) for d in range(WIDE + 1)])
        apart = 1 - (1 - np.arange(WIDE + 1) / WIDE) ** size
        while differ @ apart**blocks > MISS:
            blocks += 1
    rng = np.random.default_rng(SEED)
    order = np.concatenate([rng.permutation(WIDE) for _ in range(size * blocks // WIDE + 1)])
    return [order[i * size : (i + 1) * size] for i in range(blocks)]


def block_values(prints: list[bytes], blocks: list[np.ndarray]) -> np.ndarray:
    """(prints, blocks): the bits of each block, with its number above them."""
    bits = np.unpackbits(np.frombuffer(b"".join(prints), dtype=np.uint8).reshape(-1, WIDE // 8), axis=1, bitorder="little")
    columns = [(bits[:, b].astype(np.int64) << np.arange(len(b))).sum(axis=1) + (i << 40) for i, b in enumerate(blocks)]
    return np.stack(columns, axis=1)


def tree(prints: np.ndarray, sizes: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Places of links that connect whatever all close pairs connect: at most ``WIDE_DISTANCE`` bits, sizes that allow the similarity.

    Texts that are close to none are told apart a few hundred thousand pairs at a time. The others are reached one from
    another; whoever is reached is left out of later comparisons, so crowds form no pairs.
    """
    out, left, first = [], np.arange(len(prints)), np.ascontiguousarray(prints[:, 0])

    def close(x, y):
        fits = np.minimum(sizes[x], sizes[y]) >= similarity * np.maximum(sizes[x], sizes[y])
        return fits & (np.bitwise_count(prints[x] ^ prints[y]).sum(axis=1, dtype=np.int64) <= WIDE_DISTANCE)

    while len(left) > 1:
        some = max(1, (1 << 18) // len(left))
        i, j = np.nonzero(np.bitwise_count(first[:some, None] ^ first) <= FIRST_DISTANCE)
        i, j = i[i != j], j[i != j]
        starts = left[np.unique(i[close(left[i], left[j])])]
        left, first = np.concatenate((starts, left[some:])), np.concatenate((first[np.searchsorted(left[:some], starts)], first[some:]))
        for start in starts:
            if not len(left) or left[0] != start:
                continue  # reached meanwhile
            queue, left, first = [start], left[1:], first[1:]
            while queue and len(left):
                x = queue.pop()
                near = np.flatnonzero(np.bitwise_count(first ^ prints[x, 0]) <= FIRST_DISTANCE)
                near = near[close(np.full(len(near), x), left[near])]
                out += [(x, y) for y in left[near]]
                queue += list(left[near])
                left, first = np.delete(left, near), np.delete(first, near)
    return out


def wide_links(prints: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links of ``prints`` (id, n, print) that connect all close pairs which agree in a block, and no others.

    Fingerprints that agree in a block meet in one task, which verifies the Hamming distance of every pair it links.
    """
    blocks = wide_blocks(prints.count())
    values = F.pandas_udf(lambda p: pd.Series(list(block_values(list(p), blocks))) if len(p) else pd.Series([], dtype=object), "array<long>")
    keyed = stored(prints.select("id", "n", "print", values("print").alias("values")), "simhash-blocks")
    keyed = keyed.select("id", "n", "print", F.explode("values").alias("value"))
    crowded = keyed.groupBy("value").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")).where("parts > 1")
    crowded = stored(crowded, "simhash-crowded")
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: i != part)
    dealt = keyed.join(crowded, "value", "left").withColumn("part", part)
    dealt = dealt.withColumn("other", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(others)))
    dealt = dealt.select("value", F.coalesce(F.least("part", "other"), F.lit(0)).alias("low"), F.coalesce(F.greatest("part", "other"), F.lit(0)).alias("high"), "id", "n", "print")

    def link(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        ids = t.column("id").to_numpy()
        words = np.frombuffer(b"".join(t.column("print").to_pylist()), dtype=np.uint64).reshape(-1, WIDE // 64)
        found = np.array(tree(words, t.column("n").to_numpy(), similarity), dtype=np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(ids[found[:, 0]], pa.int64()), "b": pa.array(ids[found[:, 1]], pa.int64())})

    return dealt.groupBy("value", "low", "high").applyInArrow(link, "a long, b long")


def near_duplicates(documents: DataFrame, shingle: int = SHINGLE, seed: int = SEED, text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of ``documents``.

    component_id is the smallest doc_id that can be reached over links of at most two differing bits. Null, empty and
    wordless texts have fingerprint zero and link like any other; copies share a fingerprint and so a component;
    repeated rows are kept; null doc_ids get a row, and only a group of nothing but null ids has a null component.
    """
    prints = stored(fingerprints(documents.select("doc_id", F.col(text).alias("text")), shingle, seed).select("doc_id", "fingerprint"), "simhash")
    first = stored(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "simhash-first")
    rooted = _rooted(first)
    small = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    final = rooted.join(small, "root").select("fingerprint", "component_id")
    return prints.join(final, "fingerprint").select("doc_id", "fingerprint", "component_id")


def _rooted(first: DataFrame) -> DataFrame:
    """``first`` (a row per fingerprint) with ``root``: the smallest fingerprint that can be reached."""
    roots = components(links(first))
    return first.join(roots, first["fingerprint"] == roots["node"], "left").withColumn("root", F.coalesce("root", "fingerprint")).drop("node")


def deduplicate(documents: DataFrame, shingle: int = SHINGLE, seed: int = SEED, text: str = "text") -> DataFrame:
    """One row of each group of ``near_duplicates``, with its columns as they were: that of the smallest doc_id.

    Null ids come last, smaller text hashes first; of rows alike in id and text one stays. A row is known by its id and
    the hash of its text; columns of maps or variants, which have no order, do not decide which of such rows stays. Rows alike are brought down to one before the shuffle, so no row that a third of the table
    repeats lands in one task, and the texts are shuffled once. Empty table: no rows.
    """
    body = F.col(text).cast("string")
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("string").alias("same"), F.xxhash64(body).alias("h"))
    place = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), key.alias("key"))
    prints = fingerprints(documents.select("doc_id", body.alias("text"), place.alias("place")), shingle, seed, output="fingerprint")
    first = stored(prints.groupBy("fingerprint").agg(F.min("place").alias("place")), "simhash-first")
    keepers = _rooted(first).groupBy("root").agg(F.min("place").alias("place")).select("place.key")
    rows = documents.select(whole_rows(documents).alias("row"), key.alias("key"))
    sortable = [F.col(f"row.`{f.name}`") for f in documents.schema if not re.search("map<|variant|void", f.dataType.simpleString())]
    alike = rows.groupBy("key").agg(F.min_by("row", F.struct(*sortable)).alias("row"))
    return alike.join(keepers, "key", "left_semi").select("row.*")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op4_simhash": op4_simhash}
