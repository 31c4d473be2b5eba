"""Odd rows and brute-force versions that several test modules share."""

import re

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fingerprint string, shard string, row string, `copy` string, found int"
LONG = " ".join(f"w{i % 997}x{i % 31}" for i in range(60_000))
PASSAGE = " ".join(f"p{i}" for i in range(60))


def odd_rows():
    rows = [(1, "One two three four.", "s1"), (1, "One two three four.", "s1"), (2, None, None), (3, "", "s2"), (None, "a text without id", "s1"), (None, None, None), (4, " \t\n ", "s3"), (5, LONG, "s1"), (6, "x " + PASSAGE, "s2"), (7, PASSAGE + " y", "s2"), (8, PASSAGE, None), (9, "Ünï çödé   wide space", "s2")]
    return [(i, t, None, s, None, 1.5, "f", "s", "r", "c", 7) for i, t, s in rows]


def brute_fingerprint(s):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(x).encode(), 42) for x in ([w[i : i + 3] for i in range(len(w) - 2)] or [w])]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(prints):
    ids = sorted(prints, key=lambda x: (x is None, x))
    root = {i: i for i in ids}
    find = lambda x: x if root[x] == x else find(root[x])
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def brute_kept(rows, k=5, least=0.8):
    """The smallest id of each group that is linked by pairs of similar texts."""
    sets = {i: frozenset(zip(*(w[j:] for j in range(k)))) if len(w) >= k else frozenset([tuple(w)] if w else []) for i, t in rows for w in [(t or "").lower().split()]}
    ids, root = sorted(sets), {i: i for i in sets}
    find = lambda x: x if root[x] == x else find(root[x])
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted({find(i) for i in ids})
