"""N-gram Jaccard self-join by a token-group matrix.

A document is the set of its 64-bit shingle hashes. Documents whose sets are equal
are one class. Similar classes are put into groups, each group's token union is
stored as rows (token, group), a query's overlap with a union is bounded by the
tokens that both hold, and only groups whose bound reaches the threshold are
opened and compared exactly.

How the matrix stays small: under one order of all tokens, two sets with Jaccard
0.8 or more share at least l of the first n - ceil(0.8 n) + l tokens of either,
for any l, so unions of these prefixes suffice. Any order is right; tokens that a
first pass finds frequent come last in it. Within prefixes, a second order is by
exact frequency. If x is the rarest prefix token that two sets share there, their
overlap is at most the shared prefix tokens from x on, plus what lies behind the
longer prefix; so x asks for a group only where both have enough such tokens, and
a passage that many documents share asks for none. The bound of a query and a
group then counts in whole prefixes. How groups are found: classes with an equal least token
under one of four permutations meet in blocks of bounded size and are compared
with a few leaders there; whatever links is a group. The matrix then finds every
link between different groups that this missed.

Defined cases: null text and text without words have an empty set and link with
nothing; repeated rows and equal texts are linked; rows of one id with different
texts are linked through nothing but their texts; an empty table gives no rows;
further columns are not read. Tokens are compared by 64-bit hash, as are classes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import bucketed, discard, mapped, materialise, mix, shingle_sets, slices
from .components import components

WORDS, PERCENT = 5, 80
#: Permutations that propose groups; classes in a block; representatives of a group in a block of another permutation.
KEYS, BLOCK, PIVOTS = 4, 512, 3
#: Tokens in a block, on average, where classes are large.
BLOCK_TOKENS = 500_000
#: A token counted so often, within parts of the input, comes late in the order; so many at most, the most frequent ones. Both only change the time.
FREQUENT, FREQUENT_MOST = 2, 1 << 18
#: The largest filter of ids that the scan for sets gets: 8 MB.
FILTER_BITS = 1 << 26
#: Rows of one token that wait until all of them are counted.
WAIT = 100_000
#: Tokens that one counting step holds.
STEP_TOKENS = 1_000_000

_SEEDS = mix(np.arange(101, 101 + KEYS, dtype=np.uint64))
_i64 = lambda a: a.view(np.int64)


#: Of a set of n tokens, l is 1 + n div SHARE.
SHARE = 25
#: Rounding that the bound over a range of sizes allows for.
SLACK = 3


def extra(n):
    """l: the shared prefix tokens asked for."""
    return 1 + n // SHARE


def _least(n, percent: int):
    """The smallest set that one of n tokens may link with, in whole numbers."""
    return F.floor((percent * n + 99) / 100)


def _needed(n, m, percent: int):
    """Shared prefix tokens that sets of n and m tokens cannot link without: the overlap that the threshold asks for, less what lies behind the longer prefix."""
    behind = lambda k: _least(k, percent) - 1 - F.floor(k / SHARE)
    overlap = F.floor((percent * (n + m) + 99 + percent) / (100 + percent))
    return overlap - F.greatest(behind(n), behind(m))


def _needed_of(n, low, high, percent: int):
    """The same for a partner of some size from low to high: least at an end of the range that can link."""
    a, b = F.greatest(_least(n, percent), low), F.least(F.floor(100 * n / percent), high)
    return F.greatest(F.lit(1), F.least(_needed(n, a, percent), _needed(n, b, percent)) - SLACK)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return min(n, n - -(-percent * n // 100) + extra(n))


def linked(common: np.ndarray, a, b, percent: int = PERCENT) -> np.ndarray:
    return 100 * common >= percent * (a + b - common)


def _frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of many different sets, by counts within parts of the input: sorted tokens and their class (log2 of the count)."""
    schema = pa.schema([("token", pa.int64()), ("c", pa.int64())])

    def count(sets: list[np.ndarray]) -> pa.RecordBatch:
        t, c = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        return pa.RecordBatch.from_arrays([pa.array(_i64(t[c > 1])), pa.array(c[c > 1].astype(np.int64))], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size, seen = 0, set()
        for b in batches:
            for s in shingle_sets(b.column(0), WORDS):
                key = (len(s), int(s.sum())) if len(s) else None
                if key is None or key in seen:
                    continue
                seen.add(key)
                held.append(s)
                size += len(s)
                if size >= STEP_TOKENS:
                    yield count(held)
                    held, size, seen = [], 0, set()
        yield count(held)

    top = mapped(docs.select("text"), run, "token long, c long").groupBy("token").agg(F.sum("c").alias("c")).where(F.col("c") >= FREQUENT)
    got = top.orderBy(F.desc("c"), "token").limit(FREQUENT_MOST).toArrow()
    token = got["token"].to_numpy().view(np.uint64)
    order = np.argsort(token)
    return token[order], np.log2(np.maximum(got["c"].to_numpy(), 1)).astype(np.int64)[order]


class _Order:
    """The order of all tokens: those that are not frequent by value, then the frequent ones by class and value."""

    def __init__(self, token: np.ndarray, level: np.ndarray):
        self.token, self.level = token, level
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[token >> np.uint64(44)] = True

    def prefix(self, s: np.ndarray, p: int) -> np.ndarray:
        may = np.flatnonzero(self.maybe[s >> np.uint64(44)])
        if len(may):
            at = np.minimum(np.searchsorted(self.token, s[may]), len(self.token) - 1)
            is_it = self.token[at] == s[may]
            often, at = may[is_it], at[is_it]
            if len(often):
                rare = np.delete(s, often)
                if len(rare) >= p:
                    return rare[:p]
                return np.concatenate([rare, s[often][np.lexsort([s[often], self.level[at]])]])[:p]
        return s[:p]


def _signature(s: np.ndarray) -> int:
    return int(_i64(mix(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(keepdims=True) + np.uint64(len(s))))[0])


def _signatures(docs: DataFrame, token: np.ndarray, level: np.ndarray) -> DataFrame:
    """doc_id, n, s (the set's 64-bit signature), keys and prefix; the latter two are given once for each class in a partition."""
    shared = docs.sparkSession.sparkContext.broadcast((token, level))  # at most FREQUENT_MOST tokens
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("s", pa.int64()), ("keys", pa.list_(pa.int64())), ("prefix", pa.list_(pa.int64()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = _Order(*shared.value)
        seen: set[int] = set()
        for b in batches:
            for part in slices(b, 1):
                n, sig, keys, prefixes = [], [], [], []
                for s in shingle_sets(part.column(1), WORDS):
                    n.append(len(s))
                    if not len(s):
                        sig.append(None)
                        keys.append(None)
                        prefixes.append(None)
                        continue
                    g = _signature(s)
                    sig.append(g)
                    if g in seen:
                        keys.append(None)
                        prefixes.append(None)
                        continue
                    if len(seen) > 100_000:
                        seen.clear()
                    seen.add(g)
                    keys.append(_i64(np.array([mix(s ^ k).min() for k in _SEEDS])))
                    prefixes.append(_i64(order.prefix(s, prefix_length(len(s)))))
                kind = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(sig, pa.int64()), pa.array(keys, kind), pa.array(prefixes, kind)], schema=schema)

    return mapped(docs, run, "doc_id long, n long, s long, keys array<long>, prefix array<long>")


def _places(ids: pa.Array, size: int) -> np.ndarray:
    """Three bits of a filter of `size` bytes for each id."""
    h = mix(ids.fill_null(-(1 << 62)).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
    return np.stack([mix(h + np.uint64(k)) % np.uint64(8 * size) for k in range(3)]).astype(np.int64)


def _filter(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of ids, of fixed size at most: built in parts, united by word. A fuller filter lets more pass and loses nothing."""
    size = int(min(FILTER_BITS, max(1 << 12, 1 << (16 * max(1, ids.count())).bit_length())) // 8)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(_places(b.column(0), size).ravel())
            word, first = np.unique(at >> 6, return_index=True)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first) if len(at) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(_i64(bits))], names=["word", "bits"])

    got = mapped(ids, run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(size // 8, "<u8")
    words[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return words.view(np.uint8)


def _shared_tokens(signatures: DataFrame) -> DataFrame:
    """(token, s, n, df) of the prefix tokens that more than one class has; df is the number of its classes.

    Rows come sorted by token and wait for the end of their token, up to WAIT of them: rows of a more
    frequent token go out without df, and one row without s gives it at the end."""
    rows = signatures.where("prefix is not null").select(F.explode("prefix").alias("token"), "s", "n")
    wait = WAIT

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3  # rows of the last token that wait
        before = 0  # classes of that token that went out
        for b in chain(batches, [None]):
            more = [b.column(k).to_numpy() for k in range(3)] if b is not None else [np.zeros(0, np.int64)] * 3
            t, s, n = (np.concatenate(x) for x in zip(held, more, strict=True))
            if not len(t) or (b is not None and not b.num_rows):
                continue
            new = np.ones(len(t), bool)  # a copy of the row before is none
            new[1:] = (t[1:] != t[:-1]) | (s[1:] != s[:-1])
            t, s, n = t[new], s[new], n[new]
            bounds = np.flatnonzero(np.r_[True, t[1:] != t[:-1], True])
            rows = np.diff(bounds)
            df, late = rows.copy(), np.zeros(len(rows), bool)
            df[0] += before
            late[0] = before > 0
            go, total = df > 1, late.copy()
            out = np.repeat(go, rows)
            held = [np.zeros(0, np.int64)] * 3
            if b is not None:  # the last token may go on
                total[-1] = False
                late[-1] |= rows[-1] > wait
                keep = 1 if rows[-1] > wait else int(rows[-1])
                held, before = [v[-keep:] for v in (t, s, n)], int(df[-1]) - keep
                out[-keep:] = False
            heads = np.zeros(int(total.sum()), np.int64)
            none = np.r_[np.zeros(int(out.sum()), bool), np.ones(len(heads), bool)]
            open_ = np.r_[np.repeat(late, rows)[out], np.zeros(len(heads), bool)]
            columns = [np.r_[t[out], t[bounds[:-1][total]]], np.r_[s[out], heads], np.r_[n[out], heads], np.r_[np.repeat(df, rows)[out], df[total]]]
            yield pa.RecordBatch.from_arrays([pa.array(c, mask=m) for c, m in zip(columns, (None, none, none, open_), strict=True)], names=["token", "s", "n", "df"])

    shared = materialise(mapped(rows.repartition("token").sortWithinPartitions("token", "s"), run, "token long, s long, n long, df long"), "tokens")
    ready = shared.where("s is not null and df is not null")
    rest = shared.where("s is not null and df is null").drop("df").join(shared.where("s is null").select("token", "df"), "token")
    out = ready.unionByName(rest)
    out._written_at = shared._written_at  # what `discard` of the result deletes
    return out


def _runs(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of rows with equal first columns, of batches sorted by these."""
    held: list[pa.RecordBatch] = []
    current = None

    def cuts(b: pa.RecordBatch) -> list[int]:
        change = np.zeros(b.num_rows, bool)
        for k in range(keys):
            v = b.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(change).tolist()

    for b in batches:
        if not b.num_rows:
            continue
        bounds = [0, *cuts(b), b.num_rows]
        for i, j in zip(bounds[:-1], bounds[1:], strict=True):
            part = b.slice(i, j - i)
            key = tuple(part.column(k)[0].as_py() for k in range(keys))
            if held and key != current:
                yield pa.Table.from_batches(held)
                held = []
            current = key
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    lists = column.combine_chunks()
    off = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.to_numpy().view(np.uint64)[off[0] : off[-1]], off - off[0]


def _common(one: np.ndarray, all_: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Tokens that a set shares with each of many."""
    at = np.minimum(np.searchsorted(one, all_), len(one) - 1)
    total = np.concatenate([[0], np.cumsum(one[at] == all_)])
    return total[off[1:]] - total[off[:-1]]


def _within(t: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a block's classes with leaders: each class that no leader before it links becomes one."""
    ids = t["s"].to_numpy()
    tokens, off = _flat(t["tokens"])
    n = np.diff(off)
    free = np.ones(len(ids), bool)
    a, b = [], []
    for i in np.lexsort([ids, -n]):
        if not free[i]:
            continue
        hit = linked(_common(tokens[off[i] : off[i + 1]], tokens, off), n[i], n, percent)
        hit[i] = False
        free[hit] = False
        free[i] = False
        k = np.flatnonzero(hit)
        a.append(np.full(len(k), ids[i]))
        b.append(ids[k])
    return np.concatenate(a), np.concatenate(b)


def _opened(t: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """One link of each query to the opened group, if there is one: members of like size first, the rest only if need be."""
    query = t["query"].to_numpy(zero_copy_only=False)
    ids = t["s"].to_numpy()
    tokens, off = _flat(t["tokens"])
    n = np.diff(off)
    members = np.flatnonzero(~query)
    a, b = [], []
    if not len(members):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    for i in np.flatnonzero(query):
        can = members[(100 * np.minimum(n[members], n[i]) >= percent * np.maximum(n[members], n[i])) & (ids[members] != ids[i])]
        can = can[np.argsort(np.abs(n[can] - n[i]), kind="stable")]
        for part in (can[:8], can[8:]):
            if not len(part):
                break
            flat = np.concatenate([tokens[off[m] : off[m + 1]] for m in part])
            o = np.concatenate([[0], np.cumsum(n[part])])
            k = np.flatnonzero(linked(_common(tokens[off[i] : off[i + 1]], flat, o), n[i], n[part], percent))
            if len(k):
                a.append(ids[i])
                b.append(ids[part[k[0]]])
                break
    return np.array(a, np.int64), np.array(b, np.int64)


def _links(rows: DataFrame, keys: list[str], f: Callable[[pa.Table, int], tuple[np.ndarray, np.ndarray]], percent: int) -> DataFrame:
    """Links that f finds in each group of rows with equal keys; groups are of bounded size."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, len(keys)):
            if t.num_rows > 1:
                a, b = f(t, percent)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    columns = [*keys, *(c for c in rows.columns if c not in keys)]
    return mapped(rows.select(*columns).repartition(*keys).sortWithinPartitions(*keys), run, "a long, b long")


def _blocks(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of groups of two or more, with `block`: groups over BLOCK classes or BLOCK_TOKENS tokens are dealt into blocks by hash."""
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("size"), _parts(F.sum("n"), F.count("*")).alias("parts")).where("size > 1").drop("size")
    spread = F.pmod(F.xxhash64("s"), F.col("parts")).cast("int")
    return rows.join(materialise(sizes, "sizes"), keys).withColumn("block", spread).drop("parts", "n")


def _parts(tokens, rows):
    """Blocks that so many tokens and rows are dealt into."""
    return F.greatest(F.ceil(tokens / BLOCK_TOKENS), F.ceil(rows / BLOCK)).cast("long")


def _labelled(nodes: DataFrame, links: DataFrame | None) -> DataFrame:
    """nodes with `component`, their own s where nothing links them."""
    if links is None:
        return nodes.withColumn("component", F.col("s"))
    return nodes.join(components(links).withColumnRenamed("id", "s"), "s", "left").withColumn("component", F.coalesce("component", "s"))


def _classified(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, n_shingles, s (the set's signature), component and component_id of every document; the last three are null without words."""
    if not PERCENT <= percent <= 100:
        raise ValueError("the prefixes are cut for a threshold of 80 percent or more")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    wide = materialise(_signatures(d, *_frequent(d)), "prefixes")
    tokens = _shared_tokens(wide)
    signatures = materialise(wide.drop("prefix"), "signatures")
    discard(wide)
    # place: the tokens of a set that are shared at all and no rarer than this one.
    place = F.row_number().over(Window.partitionBy("s").orderBy(F.desc("df"), "token"))
    n = F.col("n")
    placed = tokens.withColumn("place", place)
    placed = bucketed(placed.select("token", "s", "n", "place", (F.col("place") >= _needed_of(n, F.lit(0), n * 2, percent)).alias("asks")), "s", "placed")
    discard(tokens)
    asking = placed.where("asks").drop("asks")
    some = asking.groupBy("s").agg(F.min("n").alias("n"))
    heads = signatures.where("s is not null").groupBy("s").agg(F.min("doc_id").alias("doc_id"), F.first("keys", True).alias("keys"))
    nodes = materialise(some.join(heads, "s"), "nodes")

    # The scan leaves out most texts that no class needs, so that only sets of candidates move.
    filter_ = d.sparkSession.sparkContext.broadcast(_filter(nodes.select("doc_id")))  # at most FILTER_BITS bits

    def expand(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = filter_.value
        for b in batches:
            for part in slices(b, 1):
                place = _places(part.column(0), len(bits))
                hit = part.filter(pa.array((bits[place >> 3] >> (place & 7) & 1).astype(bool).all(0)))
                made = [s for s in shingle_sets(hit.column(1), WORDS) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([_signature(s) for s in made], pa.int64()), pa.array([_i64(s) for s in made], pa.list_(pa.int64()))], names=["s", "tokens"])

    sets = mapped(d, expand, "s long, tokens array<long>").repartition(int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")), "s").dropDuplicates(["s"])
    sets = bucketed(sets, "s", "sets")

    # Joins below have a written table on either side: Spark can then split what one key, such as a large group, would send to one task.
    links = None
    for round_ in range(2):
        known = _labelled(nodes, links)
        ks = [0] if round_ == 0 else list(range(1, KEYS))
        keyed = known.select("s", "n", "component", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col("keys")[k].alias("g")) for k in ks))).alias("kg")).select("s", "n", "component", "kg.k", "kg.g")
        if round_:
            # A group is represented by a few of its classes, and meets others only.
            keyed = materialise(keyed, "keyed")
            mixed = keyed.groupBy("k", "g").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("k", "g")
            mixed = materialise(mixed, "mixed")
            some_of = F.pmod(F.xxhash64("s", F.lit(9)), F.lit(PIVOTS)).alias("p")
            keyed = keyed.join(mixed, ["k", "g"], "left_semi").groupBy("k", "g", "component", some_of).agg(F.min(F.struct("s", "n")).alias("of")).select("of.s", "of.n", "k", "g")
        rows = _blocks(materialise(keyed.select("s", "n", "k", "g"), "rows"), ["k", "g"]).join(sets, "s").select("k", "g", "block", "s", "tokens")
        found = _links(rows, ["k", "g", "block"], _within, percent)
        links = materialise(found if links is None else found.union(links), "found")

    # The matrix: which groups hold a token in a prefix, with the sizes of their members.
    known = materialise(_labelled(nodes, links).select("s", "n", F.col("component").alias("g")), "groups")
    groups = materialise(known.groupBy("g").agg(F.count("*").alias("size"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.sum("n").alias("tokens")), "sizes")
    known_wide = materialise(known.join(groups.drop("tokens"), "g").select("s", "g", "size", "lo", "hi"), "known")
    held = materialise(asking.join(known_wide, "s"), "held")
    matrix = materialise(held.groupBy("token", *(F.col(c).alias(f"other_{c}") for c in ("g", "size", "lo", "hi"))).agg(F.max("place").alias("top")), "matrix")
    # Of two groups the smaller one's members ask the larger one.
    asks = (F.struct("size", "g") < F.struct("other_size", "other_g")) & (5 * F.col("other_hi") >= 4 * F.col("n")) & (4 * F.col("other_lo") <= 5 * F.col("n"))
    asks = asks & (F.least("place", "top") >= _needed_of(n, F.col("other_lo"), F.col("other_hi"), percent))
    asked = materialise(held.join(matrix, "token").where(asks).select("s", "n", F.col("other_g").alias("g"), F.col("other_lo").alias("lo"), F.col("other_hi").alias("hi")).distinct(), "asked")
    # The bound, in whole prefixes: tokens of the query that the group's union holds.
    wanted = materialise(asked.select("g").distinct(), "wanted")
    wanted_of = materialise(known.join(wanted, "g", "left_semi").select("s", "g"), "wanted-of")
    union = placed.select("token", "s").join(wanted_of, "s").select("token", "g").distinct()
    overlap = asked.join(placed.select("s", "token"), "s").join(union, ["token", "g"]).groupBy("s", "g", "n", "lo", "hi").agg(F.count("*").alias("c"))
    opened = materialise(overlap.where(F.col("c") >= _needed_of(n, F.col("lo"), F.col("hi"), percent)).select("s", "g", "n"), "opened")
    queries_of = opened.groupBy("g").agg(F.count("*").alias("asks"), F.sum("n").alias("asked"))
    parts = materialise(queries_of.join(groups, "g").select("g", _parts(F.col("asked"), F.col("asks")).cast("int").alias("qs"), _parts(F.col("tokens"), F.col("size")).cast("int").alias("ms")), "parts")
    part = lambda of: F.pmod(F.xxhash64("s", F.lit(5)), F.col(of).cast("long")).cast("int")
    all_of = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    queries = opened.join(parts, "g").select("g", part("qs").alias("q"), all_of("ms").alias("m"), "s", F.lit(True).alias("query"))
    members = known.select("g", "s").join(parts, "g").select("g", part("ms").alias("m"), all_of("qs").alias("q"), "s", F.lit(False).alias("query"))
    rows = queries.unionByName(members).join(sets, "s").select("g", "q", "m", "s", "query", "tokens")
    links = materialise(_links(rows, ["g", "q", "m"], _opened, percent).union(links), "found")

    united = components(links)
    of_class = signatures.where("s is not null").groupBy("s").agg(F.min("doc_id").alias("id")).join(united.withColumnRenamed("id", "s"), "s", "left").select("s", "id", F.coalesce("component", "s").alias("component"))
    of_class = materialise(of_class, "classes")
    smallest = materialise(of_class.groupBy("component").agg(F.min("id").alias("component_id")), "smallest")
    labels = materialise(of_class.join(smallest, "component").select("s", "component", "component_id"), "labels")
    discard(sets, placed, nodes, known, groups, known_wide, held, matrix, asked, wanted, wanted_of, opened, parts, links, united, of_class, smallest)
    return signatures.select("doc_id", F.col("n").alias("n_shingles"), "s").join(labels, "s", "left").select("doc_id", "n_shingles", "s", "component", "component_id")


def jaccard_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    return _classified(docs, percent).select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _signed(docs: DataFrame) -> DataFrame:
    """The documents with a first column `s`, the signature of their set (null without words), all other columns named with an underscore before."""
    at, names = docs.columns.index("text"), ["s", *(f"_{c}" for c in docs.columns)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, at):
                s = [_signature(v) if len(v) else None for v in shingle_sets(part.column(at), WORDS)]
                yield pa.RecordBatch.from_arrays([pa.array(s, pa.int64()), *part.columns], names=names)

    return mapped(docs, run, StructType([StructField("s", LongType()), *(StructField(f"_{f.name}", f.dataType) for f in docs.schema)]))


def keep_first(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents, all columns as they are, of which each group keeps one row, that with the smallest id (null ids come last). Documents without words all stay; of rows that repeat an id and have no words one stays.

    A row goes by its own words: a repeated id with other words is a document of its own."""
    found = materialise(_classified(docs, percent), "components")
    # Ids of one row each are told apart by the id alone; repeated and null ids by id and signature.
    again = materialise(found.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1 or doc_id is null").select("doc_id"), "again")
    # What goes is less than what stays, and nearly always small.
    goes = found.where("doc_id <> component_id").select("doc_id").distinct()
    if not again.limit(1).count():
        return docs.join(goes, "doc_id", "left_anti").select(*docs.columns)
    repeated = F.col("doc_id").eqNullSafe(F.col("again"))
    again = again.select(F.col("doc_id").alias("again"))
    alone = docs.join(again, repeated, "left_anti")
    alone = alone.join(goes, "doc_id", "left_anti").select(*docs.columns)
    rows = _signed(docs.join(again, repeated, "left_semi").select(*docs.columns))
    said = found.where("s is not null").groupBy("s").agg(F.first("component").alias("c"), F.first("component_id").alias("least"))
    rows = rows.join(said, "s", "left")
    # One row of those with the group's smallest id; without words one for each id, null ids too.
    first = rows.where(F.col("s").isNull() | F.col("_doc_id").eqNullSafe(F.col("least"))).dropDuplicates(["_doc_id", "c"])
    return alone.unionByName(first.select(*(F.col(f"_{c}").alias(c) for c in docs.columns)))


def op8_ngram_join(spark, sf_dir):
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
