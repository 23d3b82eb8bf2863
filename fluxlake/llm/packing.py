"""Best-fit packing of tokenised documents into sequences of bounded length.

Only counts of lengths go to the driver, of which there are as many as a sequence
has places. There the linear grouping scheme plans all sequences at once: large
lengths, in descending order, form groups of equal cardinality and count as their
group's largest; configurations of the few group sizes are optimised by column
generation; actual lengths take their slots; what is left and all small lengths
go, longest first, where they fit best. The plan is a table of intervals: the
documents of one length with ranks lo to lo+n lie in sequences seq to seq+n, all at
one offset. It grows with the number of lengths, not of documents. A document
finds its place by its length and its rank among those of the same length.

Defined cases: null or empty text is the separator alone; repeated rows are
packed as rows of their own; ties (equal lengths) are ranked by partition and
order in it; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped, materialise, slices

LENGTH = 2048
SEPARATOR = 0
#: Ways to try: the share of a sequence from which a length is large, and the number of groups of large lengths.
TRIES = ((1 / 2, 24), (1 / 3, 160), (1 / 6, 64))
#: Runs and pieces whose ids a worker remembers in one table; a full one is kept once more for what is still in use.
REMEMBERED = 150_000
_RANK = 1 << 44
#: The printable stand-ins of bytes in byte-level vocabularies: bytes that are printable in Latin-1 stand for themselves, the rest in order from 256 on.
_OWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = [chr(b) for b in range(256)]
for _i, _b in enumerate(b for b in range(256) if b not in _OWN):
    _BYTES[_b] = chr(256 + _i)
#: Marks that often end a run; neither letters nor digits nor white space.
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: The tokenizer's own pattern, on lower-case text.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall


@dataclass
class Plan:
    """keys: length * 2**44 + first rank of an interval, ascending; seq and offset of the first document in it."""

    keys: np.ndarray
    seq: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, length * _RANK + rank, "right") - 1
        return self.seq[at] + rank - (self.keys[at] - length * _RANK), self.offset[at]


def configurations(sizes: np.ndarray, demand: np.ndarray, length: int) -> list[tuple[int, np.ndarray]]:
    """(how many sequences, items of each size in one): the linear programme over all configurations by column generation, rounded down."""
    g = len(sizes)
    if not g:
        return []
    basis = np.diag(length // sizes).astype(float)
    b = demand.astype(float)
    reach = np.arange(length + 1) - sizes[:, None]
    fits = reach >= 0
    reach = np.maximum(reach, 0)
    for _ in range(60 * g):
        y = np.linalg.solve(basis.T, np.ones(g))
        # The most valuable configuration, an unbounded knapsack: round k has the best of k items at most.
        best, picks = np.zeros(length + 1), []
        for _ in range(length // int(sizes.min())):
            with_one = best[reach] + np.where(fits, y[:, None], -np.inf)
            pick = with_one.argmax(0)
            value = with_one[pick, np.arange(length + 1)]
            more = value > best + 1e-12
            picks.append(np.where(more, pick, -1))
            best = np.where(more, value, best)
            if not more.any():
                break
        if best[length] <= 1 + 1e-7:
            break
        column, c = np.zeros(g), length
        for chosen in reversed(picks):
            if chosen[c] >= 0:
                column[chosen[c]] += 1
                c -= sizes[chosen[c]]
        d, x = np.linalg.solve(basis, column), np.linalg.solve(basis, b)
        ok = d > 1e-9
        if not ok.any():
            break
        basis[:, int(np.argmin(np.where(ok, np.maximum(x, 0) / np.where(ok, d, 1), np.inf)))] = column
    x = np.maximum(np.linalg.solve(basis, b), 0)
    left, out = demand.astype(np.int64).copy(), []
    for k in range(g):
        col = np.rint(basis[:, k]).astype(np.int64)
        n = int(min(np.floor(x[k] + 1e-6), *(left[col > 0] // col[col > 0])))
        if n > 0:
            left -= n * col
            out.append((n, col))
    return out


class _Supply:
    """Documents of one group as runs (length, first rank, number), longest first."""

    def __init__(self, runs: list[tuple[int, int, int]]):
        self.runs = runs[::-1]

    def take(self, n: int) -> list[tuple[int, int, int]]:
        out = []
        while n > 0:
            s, lo, k = self.runs.pop()
            if k > n:
                self.runs.append((s, lo + n, k - n))
                k = n
            out.append((s, lo, k))
            n -= k
        return out


def plan(counts: dict[int, int], length: int = LENGTH, tries: tuple[tuple[float, int], ...] = TRIES) -> Plan:
    """Places for counts[s] documents of each length s, 1 to length: the first best of the given ways to group."""
    least = -(-sum(s * n for s, n in counts.items()) // length)
    best = None
    for large, groups in tries:
        p = _plan(counts, length, large, groups)
        if best is None or p.sequences < best.sequences:
            best = p
        if best.sequences == least:
            break
    return best


def _plan(counts: dict[int, int], length: int, least: float, groups: int) -> Plan:
    placed: list[tuple[int, int, int, int]] = []  # length, first rank, first sequence, offset
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free places -> runs of (first sequence, number)
    rooms: list[int] = []
    made = 0

    def free(space: int, seq: int, n: int) -> None:
        if space > 0 and n > 0:
            if not room[space]:
                insort(rooms, space)
            room[space].append((seq, n))

    sizes = sorted((s for s, n in counts.items() if n > 0), reverse=True)
    large = [s for s in sizes if s >= least * length]
    total = sum(counts[s] for s in large)
    # Equal cardinality: a group ends where its share of the documents is reached, in the middle of a length if need be.
    supplies: list[_Supply] = []
    tops: list[int] = []
    demand: list[int] = []
    runs = [(s, 0, counts[s]) for s in large]
    k = min(groups, total)
    bounds = [total * i // k for i in range(k + 1)] if k else []
    whole = _Supply(runs)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        part = whole.take(b - a)
        if tops and tops[-1] == part[0][0]:  # the same size as the group before
            supplies[-1] = _Supply(supplies[-1].runs[::-1] + part)
            demand[-1] += b - a
        else:
            tops.append(part[0][0])
            supplies.append(_Supply(part))
            demand.append(b - a)
    for n, column in configurations(np.array(tops, np.int64), np.array(demand, np.int64), length):
        slots = [supplies[g].take(n) for g in range(len(tops)) for _ in range(int(column[g]))]
        # Cut where the length in any slot changes.
        cuts = sorted({0, n, *(c for slot in slots for c in np.cumsum([r[2] for r in slot]).tolist())})
        heads = [[0, 0] for _ in slots]  # run, documents taken of it
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            offset = 0
            for slot, head in zip(slots, heads, strict=True):
                s, lo, k = slot[head[0]]
                placed.append((s, lo + head[1], made + a, offset))
                offset += s
                head[1] += b - a
                if head[1] == k:
                    head[:] = [head[0] + 1, 0]
            free(length - offset, made + a, b - a)
        made += n
    rest: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for sup in supplies:
        for s, lo, k in sup.runs:
            rest[s].append((lo, k))
    for s in sizes:
        if s not in large:
            rest[s].append((0, counts[s]))
    for s in sorted(rest, reverse=True):
        for lo, m in sorted(rest[s]):
            while m > 0:
                i = bisect_left(rooms, s)
                if i < len(rooms):
                    space = rooms[i]
                    seq, n = room[space].pop()
                    if not room[space]:
                        rooms.pop(i)
                else:
                    space, seq = length, made
                    n = -(-m // (length // s))
                    made += n
                each = min(space // s, m)
                used = min(n, m // each)
                for j in range(each):
                    placed.append((s, lo + j * used, seq, length - space + j * s))
                free(space - each * s, seq, used)
                lo, m = lo + each * used, m - each * used
                if used < n:
                    free(space, seq + used, n - used)
    placed.sort()
    a = np.array(placed, np.int64).reshape(-1, 4)
    return Plan(a[:, 0] * _RANK + a[:, 1], a[:, 2], a[:, 3], made)


class Tokens:
    """Packed ids of texts; runs between white space recur and are remembered. With `added`, the tokenizer's added tokens in a text are single ids, as in the library's plain encode; else they are text."""

    def __init__(self, path: str, added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True  # that is, as text
        self.added = [t.content for t in self.model.get_added_tokens_decoder().values()] if added else []
        self.forget()
        self.end = SEPARATOR.to_bytes(4, "little")
        self.bpe = self.model.model
        self.packed = [i.to_bytes(4, "little") for i in range(max(self.model.get_vocab().values()) + 1)]

    def forget(self) -> None:
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        if not any(a in text for a in self.added):
            return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        self.model.encode_special_tokens = False
        try:
            return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        finally:
            self.model.encode_special_tokens = True

    def piece(self, p: str) -> bytes:
        """Ids of one match of the pattern, by the library's merges alone."""
        found = self.older.get(p)
        if not found:
            packed = self.packed
            found = b"".join([packed[t.id] for t in self.bpe.tokenize(p if p.isascii() else "".join([_BYTES[b] for b in p.encode()]))])
        self.known[p] = found
        return found

    def learn(self, run: str) -> bytes:
        """Runs of Latin letters, digits and printable marks recur in few pieces, in which case and neighbours do not matter; a piece has the ids of a run of itself alone. Others go through the whole tokenizer."""
        found = self.older.get(run)
        if not found:
            if run.isprintable() and (run.isascii() or max(run) < "\u0250"):
                low = run.lower()
                get, piece = self.known.get, self.piece
                if low.isalpha():
                    found = get(low) or piece(low)
                elif (word := low.rstrip(_MARKS)).isalpha():  # two pieces: letters, then marks
                    end = low[len(word) :]
                    found = (get(word) or piece(word)) + (get(end) or piece(end))
                else:
                    found = b"".join([get(p) or piece(p) for p in _PIECES(low)])
            else:
                found = self.ids(run)
        self.known[run] = found
        return found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text and the separator, little-endian, 4 bytes each."""
        out = []
        for at in range(0, len(texts), 500):
            if len(self.known) > REMEMBERED:
                self.older, self.known = self.known, {}
            get, learn = self.known.get, self.learn
            for t in texts[at : at + 500]:
                # Python takes these control characters for white space, the tokenizer does not.
                if t and (any(a in t for a in self.added) or "\x1c" in t or "\x1d" in t or "\x1e" in t or "\x1f" in t):
                    out.append(self.ids(t) + self.end)
                else:
                    out.append(b"".join([get(r) or learn(r) for r in (t or "").split()]) + self.end)
        return out


_tokens: dict[tuple[str, bool], Tokens] = {}


def tokenise(docs: DataFrame, path: str, length: int = LENGTH, with_ids: bool = False, added: bool = False) -> DataFrame:
    """One row for each document: its partition, id, number of ids, the length of its cut-off rest (0 if none), its rank by that length and of its full pieces within the partition, its pieces' CRC-32, and the ids if asked."""
    fields = [("part", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("tail", pa.int32()), ("tail_rank", pa.int64()), ("full_rank", pa.int64()), ("crcs", pa.list_(pa.int64()))]
    schema = pa.schema(fields + [("ids", pa.binary())] * with_ids)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokens.get((path, added)) or Tokens(path, added)
        _tokens[path, added] = t
        part = TaskContext.get().partitionId()
        ranks: dict[int, int] = defaultdict(int)
        full = 0
        t.forget()  # of another task
        for batch in batches:
            for b in slices(batch, 1):
                packed = t.encode(b.column(1).to_pylist())
                n = [len(p) // 4 for p in packed]
                tails, tail_ranks, fulls, crcs = [], [], [], []
                for p, k in zip(packed, n, strict=True):
                    tails.append(k % length)
                    tail_ranks.append(ranks[k % length])
                    ranks[k % length] += 1
                    fulls.append(full)
                    full += k // length
                    crcs.append([zlib.crc32(p[i : i + 4 * length]) for i in range(0, len(p), 4 * length)])
                columns = [pa.array([part] * len(n), pa.int32()), b.column(0), pa.array(n), pa.array(tails, pa.int32()), pa.array(tail_ranks), pa.array(fulls), pa.array(crcs, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(packed, pa.binary())] * with_ids, schema=schema)
        t.forget()

    kinds = "part int, doc_id long, n long, tail int, tail_rank long, full_rank long, crcs array<long>" + ", ids binary" * with_ids
    return mapped(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), run, kinds)


def pack(docs: DataFrame, path: str, length: int = LENGTH, with_ids: bool = False, added: bool = False) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset, and its packed ids if asked."""
    tokens = materialise(tokenise(docs, path, length, with_ids, added), "tokens")
    here = tokens.groupBy("part", "tail").agg(F.count("*").alias("k"))
    counts = {int(r["tail"]): int(r["k"]) for r in here.where("tail > 0").groupBy("tail").agg(F.sum("k").alias("k")).collect()}  # at most length - 1 rows
    p = plan(counts, length)
    before = Window.partitionBy("tail").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    tail_starts = here.select("part", "tail", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("tail_start"))
    # One row for each partition.
    all_before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    full_starts = tokens.groupBy("part").agg(F.sum(F.expr(f"n div {length}")).alias("k")).select("part", F.coalesce(F.sum("k").over(all_before), F.lit(0)).alias("full_start"))
    starts = tail_starts.join(full_starts, "part")
    ranked = tokens.join(starts, ["part", "tail"]).select(
        "doc_id", "n", "tail", (F.col("tail_start") + F.col("tail_rank")).alias("rank"), (F.col("full_start") + F.col("full_rank")).alias("full"), "crcs", *["ids"] * with_ids
    )
    shared = docs.sparkSession.sparkContext.broadcast(p)  # bounded by the number of lengths
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id",)] + [("piece", pa.int32())] + [(c, pa.int64()) for c in ("start", "length", "ids_crc32", "sequence_id", "offset")] + [("ids", pa.binary())] * with_ids)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            get = lambda k: batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64)  # noqa: B023, E731
            n, tail, rank, full = get(1), get(2), get(3), get(4)
            pieces = -(-n // length)
            of = np.repeat(np.arange(len(n)), pieces)
            first = np.cumsum(pieces) - pieces
            piece = np.arange(len(of)) - first[of]
            is_tail = (tail[of] > 0) & (piece == pieces[of] - 1)
            seq, offset = p.sequences + full[of] + piece, np.zeros(len(of), np.int64)
            if is_tail.any():
                seq[is_tail], offset[is_tail] = p.place(tail[of][is_tail], rank[of][is_tail])
            size = np.where(is_tail, tail[of], length)
            crcs = batch.column(5).flatten()
            columns = [batch.column(0).take(pa.array(of)), pa.array(piece.astype(np.int32)), pa.array(piece * length), pa.array(size), crcs, pa.array(seq), pa.array(offset)]
            if with_ids:
                ids = batch.column(6)
                columns.append(pa.array([ids[int(i)].as_py()[4 * length * k : 4 * (length * k + m)] for i, k, m in zip(of, piece, size, strict=True)], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids binary" * with_ids
    return mapped(ranked, run, kinds)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, of rows with ids: sequence_id and its packed ids. A group is bounded by the sequence's length."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: F.hex(x["ids"]))
    return packed.groupBy("sequence_id").agg(F.unhex(F.array_join(parts, "")).alias("ids"))


def op7_packing(spark, sf_dir):
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), added=True)
