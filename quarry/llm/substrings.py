"""Substring dedup: words inside passages that occur more than once are removed, found with repeated-phrase automata."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import stored, table

#: Words of a window, and of a phrase. Every window has 28 phrases; the one of smallest hash is its anchor.
WINDOW, PHRASE = 35, 8
#: Bytes of text in one shard of documents, which one task holds together with its automaton.
SHARD_BYTES = 8 << 20
_CHUNK_CHARACTERS = 600_000
_BASE, _BASE2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Words of more bytes are hashed one by one.
_LONG = 1024
#: Masks of the first 0 to 8 bytes of a little-endian word.
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)


def _stirred(x: np.ndarray) -> np.ndarray:
    """A one-to-one map of 64 bits: xor-shifts and products."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def word_hashes(b: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64 bits for every word, eight bytes of all words at a time. ``b`` has eight more bytes after the last word."""
    import xxhash

    eights = np.ndarray((len(b) - 7,), dtype="<u8", buffer=b, strides=(1,))
    h = _stirred(sizes.astype(np.uint64))
    live = np.flatnonzero(sizes <= _LONG)
    at, left = begins[live], sizes[live]
    while len(live):
        h[live] = _stirred(h[live] ^ (eights[at] & _FIRST[np.minimum(left, 8)]))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(sizes > _LONG):
        h[i] = xxhash.xxh64_intdigest(b[begins[i] : begins[i] + sizes[i]].tobytes(), 20)
    return h


def runs(h: np.ndarray, k: int, base: int = _BASE) -> np.ndarray:
    """Hashes (mod 2^64) of all runs of k words, from the binary digits of k; order of words matters."""
    _power = lambda i: np.uint64(pow(base, i, 1 << 64))
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out, done, size, block = np.zeros(n, dtype=np.uint64), 0, 1, h
    while True:
        if k & size:
            out = out * _power(size) + block[done : done + n]
            done += size
        if done == k:
            return out
        block = block[:-size] * _power(size) + block[size:]
        size *= 2


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """Minimum or maximum of every ``width`` neighbours."""
    size, out = 1, x
    while size * 2 <= width:
        out = pick(out[:-size], out[size:])
        size *= 2
    return pick(out[: len(x) - width + 1], out[width - size : len(x) - size + 1]) if width > size else out


class Chunk:
    """Words of some neighbouring documents: their bytes, a space after each, and their hashes. Windows lie inside one document."""

    def __init__(self, texts: list[str | None]):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        b = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)
        blank = (b == 32) | ((b >= 9) & (b <= 13))
        last = np.concatenate(([False], ~blank[:-1])) & blank  # the blank after each word
        keep = last | ~blank
        self.bytes = np.concatenate((b[keep], np.zeros(8, dtype=np.uint8)))
        self.bytes[:-8][last[keep]] = 32
        bounds = np.cumsum([0] + [len(r) + 1 for r in raw])
        self.starts = np.searchsorted(np.flatnonzero(last), bounds)
        self.sizes = np.diff(self.starts)
        self.at = np.concatenate(([0], np.flatnonzero(last[keep]) + 1))
        self.h = word_hashes(self.bytes, self.at[:-1], np.diff(self.at) - 1)
        n = len(self.h)
        self.doc = np.repeat(np.arange(len(texts)), self.sizes)
        self.inside = self.doc[: n - WINDOW + 1] == self.doc[WINDOW - 1 :] if n >= WINDOW else np.empty(0, dtype=bool)

    def words(self, a: int, b: int, gone: np.ndarray | None = None) -> bytes:
        """Words a to b - 1 that are not ``gone``, joined by one space."""
        part = self.bytes[self.at[a] : self.at[b]]
        if gone is not None:
            part = part[np.repeat(~gone, np.diff(self.at[a : b + 1]))]
        return part[:-1].tobytes()

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes) of the phrases that are the anchor of a window."""
        if not self.inside.any():
            self.least = np.empty(0, dtype=np.uint64)
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
        phrases, width = _mixed(runs(self.h, PHRASE)), WINDOW - PHRASE + 1
        self.least = np.where(self.inside, _sliding(phrases, width, np.minimum), np.uint64(0))
        edge = np.zeros(width - 1, dtype=np.uint64)
        most = _sliding(np.concatenate((edge, self.least, edge)), width, np.maximum)
        at = np.flatnonzero((most == phrases) & (most > 0))
        return at, phrases[at]

    def anchored(self, places: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Which windows have one of these phrases, given by their places, as their anchor (after ``anchors``)."""
        some = np.full(max(len(self.h) - PHRASE + 1, 0), np.iinfo(np.uint64).max, dtype=np.uint64)
        some[places] = hashes
        return _sliding(some, WINDOW - PHRASE + 1, np.minimum) == self.least if len(self.least) else np.empty(0, dtype=bool)


Windows = tuple[np.ndarray, np.ndarray]


def windows_of(h: np.ndarray) -> Windows:
    """96 bits for every window: two hashes of its words, of unlike base and mixing, 64 and the high 32 bits of the second."""
    return runs(h, WINDOW), (runs(_mixed(h), WINDOW, _BASE2) >> np.uint64(32)).astype(np.uint32)


def _distinct(w: np.ndarray, x: np.ndarray) -> tuple[Windows, np.ndarray]:
    """Distinct windows in order, and how often each occurs."""
    order = np.lexsort((x, w))
    w, x = w[order], x[order]
    first = np.flatnonzero(np.concatenate(([True], (w[1:] != w[:-1]) | (x[1:] != x[:-1])))) if len(w) else np.empty(0, dtype=np.int64)
    return (w[first], x[first]), np.diff(np.append(first, len(w)))


def _among(w: np.ndarray, x: np.ndarray, known: Windows) -> np.ndarray:
    """Which windows are among the ``known`` ones (in order, distinct)."""
    found, (kw, kx) = np.zeros(len(w), dtype=bool), known
    if len(kw):
        at = np.searchsorted(kw, w)
        for _ in range(int(np.diff(np.flatnonzero(np.concatenate(([True], kw[1:] != kw[:-1], [True])))).max())):  # 1, but for equal first hashes
            at_ = np.minimum(at, len(kw) - 1)
            found |= (kw[at_] == w) & (kx[at_] == x)
            at = at + 1
    return found


def _chunks(texts: Iterator[str | None]) -> Iterator[Chunk]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t or "") + 1
        if size >= _CHUNK_CHARACTERS:
            yield Chunk(part)
            part, size = [], 0
    if part:
        yield Chunk(part)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        shards, at = b.column("shard").to_numpy(), 0
        for c in _chunks(x.as_py() for x in b.column("text")):
            places, hashes = c.anchors()
            own = shards[at : at + len(c.sizes)][c.doc[places]]
            at += len(c.sizes)
            if len(hashes):
                order = np.lexsort((own, hashes))
                h, own = hashes[order], own[order]
                first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (own[1:] != own[:-1]))))
                own = np.where(np.diff(np.append(first, len(h))) > 1, -1 - own[first], own[first]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(own)], names=["h", "shard"])


def _repeated(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, those marked as several (by a negative shard) or next to one of their key; one row is held back."""
    held = None  # the last row: key, shard, and whether it is known to be repeated
    for b in batches:
        if not b.num_rows:
            continue
        keys, shard = [b.column(k).to_numpy() for k in key], b.column("shard").to_numpy()
        shard, again = np.where(shard < 0, -1 - shard, shard), shard < 0
        if held is not None:
            keys = [np.concatenate(([k], x)) for k, x in zip(held[0], keys)]
            shard, again = np.concatenate(([held[1]], shard)), np.concatenate(([held[2]], again))
        same = np.logical_and.reduce([x[1:] == x[:-1] for x in keys])
        again = again | np.concatenate((same, [False])) | np.concatenate(([False], same))
        held = [x[-1] for x in keys], shard[-1], again[-1]
        at = np.flatnonzero(again[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(shard[at].astype(np.int32)), *(pa.array(x[at]) for x in keys)], names=["shard", *key])
    if held is not None and held[2]:
        yield pa.RecordBatch.from_arrays([pa.array([held[1]], pa.int32()), *(pa.array(np.array([k])) for k in held[0])], names=["shard", *key])


def _spaced(words: bytes) -> bytes:
    return b" " + words + b" "


def _hits(automaton, words: bytes) -> np.ndarray:
    """Places of all phrases of the automaton in one document."""
    text = _spaced(words)
    ends = np.fromiter((e for e, _ in automaton.iter(text.decode("utf-8", "surrogatepass"))), dtype=np.int64)
    if not len(ends):
        return ends
    b = np.frombuffer(text, dtype=np.uint8)
    stops = np.flatnonzero(b[(b & 0xC0) != 0x80] == 32)[1:]  # in characters; bytes 10xxxxxx continue one
    return np.searchsorted(stops, ends) - PHRASE + 1


def _candidates(docs: pa.Table, known: pa.Table) -> pa.Table:
    """One shard: an automaton of its recurring phrases, and the windows around every occurrence of one that is their anchor.

    Gives a row per document (with its text if it has such windows, else with its digest) and one with the windows' hashes.
    """
    import ahocorasick

    recurring = np.sort(known.column("h").to_numpy().view(np.uint64)) if len(known) else np.empty(0, dtype=np.uint64)
    phrases, chunks = set(), []
    for c in _chunks(x.as_py() for x in docs.column("text")):
        may = None
        if len(recurring):
            places, hashes = c.anchors()
            again = recurring[np.minimum(np.searchsorted(recurring, hashes), len(recurring) - 1)] == hashes
            phrases.update(c.words(p, p + PHRASE) for p in places[again])
            may = c.anchored(places[again], hashes[again])
        chunks.append((c, may))
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for p in phrases:
        automaton.add_word(_spaced(p).decode("utf-8", "surrogatepass"))
    if phrases:
        automaton.make_automaton()
    sizes, whole, digests, found = [], [], [], [(np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.uint32))]
    for c, may in chunks:
        w, x = windows_of(c.h) if phrases else (None, None)
        for n, s in zip(c.sizes.tolist(), c.starts.tolist()):
            own, some = c.words(s, s + n), False
            if phrases and n >= WINDOW and may[s : s + n - WINDOW + 1].any():
                hits = _hits(automaton, own)
                edge, last = np.zeros(n - WINDOW + 2, dtype=np.int64), n - WINDOW
                np.add.at(edge, np.clip(hits - (WINDOW - PHRASE), 0, last + 1), 1)
                np.add.at(edge, np.minimum(hits, last) + 1, -1)
                at = s + np.flatnonzero((np.cumsum(edge)[:-1] > 0) & may[s : s + last + 1])
                some = len(at) > 0
                found.append((w[at], x[at]))
            sizes.append(n)
            whole.append(some)
            digests.append(None if some else hashlib.sha256(own).hexdigest())
    del chunks
    (w, x), counts = _distinct(*(np.concatenate(part) for part in zip(*found)))
    shard = (docs if len(docs) else known).column("shard")[0].as_py()
    none = lambda kind: pa.nulls(1, kind)
    ids = docs.column("doc_id").combine_chunks() if len(docs) else pa.array([], pa.int64())
    rows = len(docs)
    return pa.table({
        "shard": pa.array([shard] * (rows + 1), pa.int32()),
        "doc_id": pa.concat_arrays([ids, none(pa.int64())]),
        "n_words": pa.array([*sizes, None], pa.int64()),
        "text": pa.array([t.as_py() if s else None for t, s in zip(docs.column("text"), whole)] + [None], pa.string()),
        "kept_sha256": pa.array([*digests, None], pa.string()),
        "windows": pa.array([None] * rows + [w.tobytes()], pa.binary()),
        "checks": pa.array([None] * rows + [x.tobytes()], pa.binary()),
        "counts": pa.array([None] * rows + [(counts > 1).tobytes()], pa.binary()),
    })


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a window; ``shard`` is given as -1 - shard if the shard holds the window more than once."""
    for b in batches:
        for shard, *columns in zip(b.column("shard").to_pylist(), b.column("windows"), b.column("checks"), b.column("counts")):
            w, x, many = (np.frombuffer(c.as_buffer(), dtype=t) for c, t in zip(columns, (np.int64, np.int32, bool)))
            own = np.where(many, -1 - shard, shard).astype(np.int32)
            for i in range(0, len(w), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(a[i : i + 100_000]) for a in (w, x, own)], names=["w", "x", "shard"])


def _removed(docs: pa.Table, known: pa.Table) -> pa.Table:
    """One shard: the words covered by its recurring windows, as ranges, and what is left of each document."""
    recurring, _ = _distinct(known.column("w").to_numpy().view(np.uint64), known.column("x").to_numpy().view(np.uint32)) if len(known) else ((np.empty(0, dtype=np.uint64),) * 2, None)
    removed, digests, spans = [], [], []
    for c in _chunks(x.as_py() for x in docs.column("text")):
        again = _among(*windows_of(c.h), recurring)
        for n, s in zip(c.sizes.tolist(), c.starts.tolist()):
            starts = np.flatnonzero(again[s : s + max(0, n - WINDOW + 1)])
            edge = np.zeros(n + 1, dtype=np.int64)
            edge[starts] += 1
            edge[starts + WINDOW] -= 1
            gone = np.cumsum(edge)[:n] > 0
            removed.append(int(gone.sum()))
            digests.append(hashlib.sha256(c.words(s, s + n, gone)).hexdigest())
            turn = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
            spans.append([{"start": int(a), "end": int(b)} for a, b in turn.reshape(-1, 2)])
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    return pa.table({
        "doc_id": docs.column("doc_id").combine_chunks() if len(docs) else pa.array([], pa.int64()),
        "n_words": docs.column("n_words").combine_chunks() if len(docs) else pa.array([], pa.int64()),
        "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string()), "removed": pa.array(spans, span),
    })


def repeated_passages(documents: DataFrame, text: str = "text", shard_bytes: int = SHARD_BYTES, spread: Column | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, removed): one row per row of ``documents``.

    ``removed`` lists the word ranges covered by windows of 35 words whose sequence also starts elsewhere, the same
    document included. Every window has an anchor, the phrase of 8 words with the smallest hash in it; equal windows
    have equal anchors, so only windows whose anchor recurs can repeat. Anchors are counted over all documents. Each
    shard of documents then compiles an Aho-Corasick automaton of the recurring phrases that its documents hold, streams
    its documents through it, and offers the windows around all occurrences that are their anchors; those counted twice or
    more over all shards are repeated. So each document passes one automaton, however many shards there are, and only recurring phrases and
    windows are shuffled. A window is known by 96 bits of its words' hashes, which
    tell 10^14 windows apart (expected collisions: 0.06; anchors have 64 bits, as they only propose).

    Rows are dealt to shards by doc_id and ``spread``, an expression over ``documents`` that gives a row the same value
    whenever it is read (by default the text, so that rows alike in both share a shard; a file's row index parts them).
    Phrases and windows are counted within a shard, then sorted by key, and rows next to one of their key are kept in
    passing, so a phrase that is in all shards is held by no task as a group.

    Null and empty texts have no words and the digest of nothing; texts of fewer than 35 words lose none; whole texts of
    any length are read; repeated rows repeat each other's passages; null doc_ids are kept. Empty table: no rows.
    """
    body = F.col(text).cast("string")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), body.alias("text"), (body if spread is None else spread).alias("spread"))
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    shards = total // shard_bytes + 1
    docs = docs.withColumn("shard", F.pmod(F.xxhash64("doc_id", "spread"), F.lit(shards)).cast("int")).drop("spread")

    def twice(rows: DataFrame, key: list[str]) -> DataFrame:
        """(shard, key) of the rows whose key is counted twice or more."""
        kinds = "shard int, " + ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in key)
        return rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(lambda batches: _repeated(batches, key), kinds)

    recurring = twice(docs.select("shard", "text").mapInArrow(_anchor_rows, "h long, shard int"), ["h"])
    first = docs.groupBy("shard").cogroup(recurring.groupBy("shard")).applyInArrow(
        _candidates, "shard int, doc_id long, n_words long, text string, kept_sha256 string, windows binary, checks binary, counts binary"
    )
    first = stored(first, "passages", "zstd")
    windows = first.where("windows IS NOT NULL").select("shard", "windows", "checks", "counts").mapInArrow(_window_rows, "w long, x int, shard int")
    repeated = twice(windows, ["w", "x"])
    held = first.where("text IS NOT NULL").select("shard", "doc_id", "n_words", "text")
    out = "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<start: int, end: int>>"
    changed = held.groupBy("shard").cogroup(repeated.groupBy("shard")).applyInArrow(_removed, out)
    same = first.where("kept_sha256 IS NOT NULL").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", F.array().cast("array<struct<start: int, end: int>>").alias("removed"))
    return same.unionByName(changed)


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.col("_metadata.row_index")
    return repeated_passages(table(spark, sf_dir, "documents"), spread=row).select("doc_id", "n_words", "n_removed", "kept_sha256")


QUERIES = {"op6_substrings": op6_substrings}
ORACLE_SQL = {
    "op6_substrings": r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
g AS (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM d WHERE len(ws) >= 35),
h AS MATERIALIZED (SELECT r, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h FROM g),
o AS MATERIALIZED (SELECT r, i FROM h SEMI JOIN (SELECT h FROM h GROUP BY h HAVING count(*) > 1) USING (h)),
x AS MATERIALIZED (SELECT DISTINCT r, unnest(range(i, i + 35)) AS j FROM o),
w AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS j FROM d),
k AS (SELECT r, count(*) AS kept, string_agg(word, ' ' ORDER BY j) AS s FROM w ANTI JOIN x USING (r, j) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(kept, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)
"""
}
