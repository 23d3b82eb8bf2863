"""Byte-level BPE by ranks: encoding and decoding.

Merging keeps a segment tree over byte positions. Leaf i holds the rank of the
pair that starts at the live token at i; an inner node holds the least rank
below it, the left one on ties, so the root leads to the leftmost minimum. A
merge changes three leaves (its own, its left neighbour's and the swallowed
one's), each a logarithmic update, so a piece of n bytes takes O(n log n).
Short pieces are merged many at a time: their trees are the rows of one array,
and each step takes every live row's root down to its leaf and updates the paths
of its three leaves. Longer pieces have a tree of their own.

Text is cut at every space before a non-space character, where the pattern
always has a boundary; the runs in between recur, so their ids are remembered
in bounded tables.

Defined cases: null or empty text has no ids; a text of any length is encoded
whole, and one piece of any length merges in O(n log n); repeated rows are encoded
row by row; an empty table gives no rows; further columns, whatever their names,
are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import mapped, slices

#: Entries that each table of remembered runs may hold before it is emptied, and characters of the longest run in it.
REMEMBERED, LONGEST = 250_000, 64
#: Bytes of the longest piece that is merged with others, and pieces merged together.
TOGETHER, ROWS = 64, 4096
_NONE = 1 << 60
#: In arrays: no pair here, and the place behind a piece's last token.
_NO_PAIR, _NO_TOKEN = 1 << 30, 1 << 29


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    size = 1
    while size < n:
        size *= 2
    tree = [_NONE] * (2 * size)
    get = ranks.get
    for i in range(n - 1):
        tree[size + i] = get(piece[i : i + 2], _NONE)
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a <= b else b
    end = list(range(1, n + 1))  # of the live token that starts here
    left = list(range(-1, n - 1))

    def put(i: int, rank: int) -> None:
        k = size + i
        tree[k] = rank
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            least = a if a <= b else b
            if tree[k] == least:
                return
            tree[k] = least
            k >>= 1

    while tree[1] != _NONE:
        least, k = tree[1], 1
        while k < size:
            k *= 2
            if tree[k] != least:
                k += 1
        i = k - size
        j = end[i]
        e = end[i] = end[j]
        put(j, _NONE)
        put(i, get(piece[i : end[e]], _NONE) if e < n else _NONE)
        if e < n:
            left[e] = i
        h = left[i]
        if h >= 0:
            put(h, get(piece[h:e], _NONE))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class Merges:
    """Ranks of pairs of ids, and merging of many short pieces at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for whole, rank in ranks.items():
            for i in range(1, len(whole)):
                a, b = ranks.get(whole[:i]), ranks.get(whole[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        keys, values = np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs))
        order = np.argsort(keys)
        self.keys, self.values = np.append(keys[order], np.iinfo(np.int64).max), np.append(values[order], np.int32(_NO_PAIR))

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.values[at], _NO_PAIR).astype(np.int32)

    def many(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Packed ids of each piece."""
        out, by_size = {}, {}
        for p in pieces:
            rank = self.ranks.get(p)
            if rank is not None:
                out[p] = rank.to_bytes(4, "little")
            elif len(p) > TOGETHER:
                out[p] = np.array(merge(p, self.ranks), "<u4").tobytes()
            else:
                by_size.setdefault(1 << (len(p) - 1).bit_length(), []).append(p)
        for size, group in by_size.items():
            for at in range(0, len(group), ROWS):
                self._rows(size, group[at : at + ROWS], out)
        return out

    def _rows(self, size: int, pieces: list[bytes], out: dict[bytes, bytes]) -> None:
        rows, width, levels = len(pieces), size + 2, size.bit_length() - 1
        n = np.fromiter(map(len, pieces), np.int64, rows)
        raw = np.frombuffer(b"".join([p.ljust(size, b"\0") for p in pieces]), np.uint8).reshape(rows, size)
        # Two places more than bytes: what lies behind the last token of this row and before the first of the next one.
        token = np.full((rows, width), _NO_TOKEN, np.int32)
        inside = np.arange(size) < n[:, None]
        token[:, :size][inside] = self.byte[raw[inside]]
        after, before = np.tile(np.arange(1, width + 1), (rows, 1)), np.tile(np.arange(-1, width - 1), (rows, 1))
        live = token < _NO_TOKEN
        tree = np.full((rows, 2 * size), _NO_PAIR, np.int32)
        tree[:, size:] = self.pair(token[:, :size].ravel(), token[:, 1 : size + 1].ravel()).reshape(rows, size)
        for k in range(levels - 1, -1, -1):
            a, b = 1 << k, 2 << k
            tree[:, a:b] = np.minimum(tree[:, b : 2 * b : 2], tree[:, b + 1 : 2 * b : 2])
        t, token_, after_, before_, live_ = tree.ravel(), token.ravel(), after.ravel(), before.ravel(), live.ravel()
        active = np.arange(rows)
        while True:
            least = t[active * (2 * size) + 1]
            more = least < _NO_PAIR
            if not more.any():
                break
            active, least = active[more], least[more]
            root, place = active * (2 * size), active * width
            k = np.ones(len(active), np.int64)
            for _ in range(levels):
                k *= 2
                k += t[root + k] != least
            i = place + k - size
            j = after_[i]
            e = after_[place + j]
            token_[i] = least  # a merged pair's id is its rank
            live_[place + j] = False
            after_[i] = e
            before_[place + e] = k - size
            h = before_[i]
            rank = self.pair(np.concatenate([least, token_[place + h]]), np.concatenate([token_[place + e], least]))
            m = len(active)
            # Leaf 0 is no place of the tree: there goes what has no left neighbour.
            leaf = np.concatenate([root + k, root + np.where(h >= 0, size + h, 0), root + size + j])
            t[leaf[:m]], t[leaf[m : 2 * m]], t[leaf[2 * m :]] = rank[:m], rank[m:], _NO_PAIR
            base = np.tile(root, 3)
            leaf -= base
            for _ in range(levels):
                leaf >>= 1
                below = base + 2 * leaf
                t[base + leaf] = np.minimum(t[below], t[below + 1])
        packed = token[live].astype("<u4").tobytes()
        ends = (4 * np.cumsum(live.sum(1))).tolist()
        for p, a, b in zip(pieces, [0, *ends], ends, strict=False):
            out[p] = packed[a:b]


class Codec:
    """Encodes text as packed little-endian unsigned 32-bit ids, and decodes them."""

    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        self.merges = Merges(self.ranks)
        self.pieces = regex.compile(pattern).findall
        self.runs = re.compile(r"(?= \S)").split
        self.table = [b""] * (max(self.ranks.values()) + 1)
        for b, i in self.ranks.items():
            self.table[i] = b
        self.odd = re.compile(r" (?=\s|\Z)").search
        self.forget()

    def forget(self) -> None:
        self.of_piece: dict[str, bytes] = {}
        self.of_run: dict[str, bytes] = {}
        self.of_spaced: dict[str, bytes] = {}  # of runs after their space, without it

    def _learn(self, runs: list[list[str]]) -> list[bytes]:
        """Packed ids of runs, each given as its pieces."""
        new = set().union(*runs) - self.of_piece.keys()
        found = self.merges.many([p.encode() for p in new])
        here = {p: found[p.encode()] for p in new}
        known = self.of_piece
        out = [b"".join([here.get(p) or known[p] for p in r]) for r in runs]
        if len(known) + len(here) > REMEMBERED:
            known.clear()
        known.update((p, v) for p, v in here.items() if len(p) <= LONGEST)
        return out

    def _spaced(self, runs: list[str]) -> list[list[str]]:
        """Pieces of each run after its space: together, as each space starts a run."""
        out: list[list[str]] = []
        for p in self.pieces(" " + " ".join(runs)) if runs else []:
            if p[0] == " ":
                out.append([p])
            else:
                out[-1].append(p)
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        cut: list[tuple[list[str], list[str]]] = []  # runs as they are, runs without their space
        for text in texts:
            if not text:
                cut.append(([], []))
            elif self.odd(text):
                cut.append(([r for r in self.runs(text) if r], []))
            else:  # every space stands before a character that is none, so each starts a run
                first, *rest = text.split(" ")
                cut.append(([first] if first else [], rest))
        tables = []
        for k, known in enumerate((self.of_run, self.of_spaced)):
            new = list(set().union(*[c[k] for c in cut]) - known.keys())
            ids = self._learn(self._spaced(new) if k else [self.pieces(r) for r in new])
            here = dict(zip(new, ids, strict=True))
            if len(here) < len(new) or len(known) + len(here) > REMEMBERED:
                here = {r: known[r] for c in cut for r in c[k] if r in known} | here
                known.clear()
            known.update((r, v) for r, v in here.items() if len(r) <= LONGEST)
            tables.append((here, known))
        (runs, old_runs), (spaced, old_spaced) = tables
        out = []
        for whole, rest in cut:
            out.append(b"".join([old_runs.get(r) or runs[r] for r in whole] + [old_spaced.get(r) or spaced[r] for r in rest]))
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec per worker process."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids, the tokens of each whole text."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    return _encoded(docs, path, pattern, schema, "doc_id long, ids array<int>", lambda c, ids: (np.frombuffer(ids, "<u4").astype(np.int32),))


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and SHA-256 of the packed ids and of the bytes that they decode to."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    row = lambda c, ids: (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest())
    return _encoded(docs, path, pattern, schema, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", row)


def _encoded(docs: DataFrame, path: str, pattern: str, schema: pa.Schema, kinds: str, row: Callable[[Codec, bytes], tuple]) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        try:
            for batch in batches:
                for part in slices(batch, 1):
                    made = [row(c, ids) for ids in c.encode_all([t or "" for t in part.column(1).to_pylist()])]
                    columns = zip(*made, strict=True) if made else [[] for _ in schema.names[1:]]
                    yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(list(v), f.type) for v, f in zip(columns, list(schema)[1:], strict=True))], schema=schema)
        finally:
            c.forget()

    return mapped(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), run, kinds)


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and text of rows of ids; null ids give empty text. Bytes that are not UTF-8 become replacement characters."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [c.decode(np.array(ids.as_py() or [], "<u4").tobytes()).decode(errors="replace") for ids in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], schema=schema)

    return mapped(tokens.selectExpr("cast(doc_id as bigint) doc_id", "ids"), run, "doc_id long, text string")


def op2_bpe(spark, sf_dir):
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
