"""Language identification: script ranges, then Viterbi over words.

A word's script, by code point ranges, leaves only the languages whose training
words use that script; the others are out for that word. Each candidate scores the
word by its letter n-grams, and Viterbi with a penalty for every switch labels the
spans of mixed text. A text's language is the one with most letters in its spans.

Training counts n-grams on the executors and sends the sums alone, so a text of any
length trains.

Defined cases: null text and text without a letter give `und` with score 0; a
word in a script of no learned language has the same score for all; words and texts
of any length are read whole; ties take the first language in sorted order; repeated
rows are judged row by row; an empty table gives no rows; without training rows all
texts are `und`; further columns, whatever their names, are not read by `predict`
and kept by `keep`.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, mapped, slices

#: The training sample: about so many documents of each language, chosen by a hash.
SAMPLE_PER_LANG = 600
#: The model keeps so many n-grams, the most frequent ones.
MOST_GRAMS = 1 << 20
#: In nats: what a change of language costs, the most that one word can say, and what keeps a language out.
SWITCH, MOST, OUT = 6.0, 8.0, 1000.0
#: Words that a worker remembers before it starts anew, and words per vectorised step.
REMEMBERED, STEP_WORDS = 150_000, 500_000

#: First code points of scripts; each range lasts until the next.
SCRIPTS = [
    (0x0041, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0900, "devanagari"),
    (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "lao"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"),
]
_STARTS = np.array([a for a, _ in SCRIPTS])
_NAMES = sorted({s for _, s in SCRIPTS})
_OF_START = np.array([_NAMES.index(s) for _, s in SCRIPTS])

words_of = regex.compile(r"\p{L}+").findall


def scripts(words: list[str]) -> np.ndarray:
    """Number in _NAMES of the script of each word's first letter."""
    first = np.frombuffer("".join([w[0] for w in words]).encode("utf-32-le"), "<u4") if words else np.zeros(0, "<u4")
    return _OF_START[np.maximum(np.searchsorted(_STARTS, first, "right") - 1, 0)]


#: Letters are numbered 1 and up by the alphabet; so many bits a letter make the key of an n-gram of four.
BITS = 16


def gram_keys(words: list[str], alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the 1- to 4-letter n-grams of each `^word$`, and the word of each. A letter that is not in the alphabet has a number of its own."""
    text = "^" + "$^".join(words) + "$"
    points = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
    at = np.searchsorted(alphabet, points)
    known = alphabet[np.minimum(at, len(alphabet) - 1)] == points
    letter = np.where(known, at + 1, len(alphabet) + 1).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    of = np.repeat(np.arange(len(words)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(points))  # letters from here to the word's end
    keys, owners = [], []
    key = np.zeros(len(points), np.uint64)
    for k in range(4):
        key = key[: len(letter) - k] * np.uint64(1 << BITS) + letter[k:]
        inside = left[: len(key)] > k
        if k == 0:  # the mark before a word says nothing
            inside = inside & (left < np.repeat(size, size))
        keys.append(key[inside])
        owners.append(of[: len(key)][inside])
    return np.concatenate(keys), np.concatenate(owners)


@dataclass
class Model:
    langs: list[str]
    alphabet: np.ndarray  # code points, sorted
    keys: np.ndarray  # n-grams, sorted
    logs: np.ndarray  # n-gram x language; the last row is of those not learned
    allowed: np.ndarray  # script x language
    rows: dict[str, int] = field(default_factory=dict)
    table: np.ndarray | None = None


def counted(texts: Iterable[tuple[str, str]]) -> Iterator[tuple[str, str, int]]:
    """(language, n-gram, count) of the words of texts; a script counts as `=name`, a language itself as `=`."""
    held: dict[str, Counter] = {}
    for lang, text in texts:
        held.setdefault(lang, Counter()).update(words_of(text.lower()))
    for lang, words in held.items():
        found: Counter = Counter({"=": sum(words.values())})
        for w, s in zip(words, scripts(list(words)).tolist(), strict=True):
            n = words[w]
            found["=" + _NAMES[s]] += n
            marked = f"^{w}$"
            for k in (1, 2, 3, 4):
                for i in range(k == 1, len(marked) - k + 1):
                    found[marked[i : i + k]] += n
        yield from ((lang, g, n) for g, n in found.items())


def learn(counts: Iterable[tuple[str, str, int]]) -> Model:
    """Model of counts that `counted` gives, summed or not."""
    of_lang: dict[str, Counter] = {}
    for lang, g, n in counts:
        of_lang.setdefault(lang, Counter())[g] += n
    langs = sorted(of_lang)
    allowed = np.zeros((len(_NAMES), max(1, len(langs))), bool)
    for k, lang in enumerate(langs):
        total = of_lang[lang]["="]
        for i, name in enumerate(_NAMES):
            allowed[i, k] = of_lang[lang]["=" + name] > 1e-3 * total
    vocabulary = sorted({g for c in of_lang.values() for g in c if g[0] != "="})
    letters = sorted({ord(c) for g in vocabulary for c in g} | {ord("^"), ord("$")})[: (1 << BITS) - 2]
    known = set(map(chr, letters))
    vocabulary = [g for g in vocabulary if known.issuperset(g)]
    number = {chr(c): i + 1 for i, c in enumerate(letters)}
    keys = np.zeros(len(vocabulary), np.uint64)
    for i, g in enumerate(vocabulary):
        key = 0
        for c in g:
            key = key << BITS | number[c]
        keys[i] = key
    logs = np.zeros((len(vocabulary) + 1, max(1, len(langs))), np.float32)
    of_length = np.array([len(g) for g in vocabulary], int)
    for k, lang in enumerate(langs):
        c = of_lang[lang]
        n = np.array([c.get(g, 0) for g in vocabulary], float)
        total = np.bincount(of_length, n, minlength=5)
        kinds = np.bincount(of_length, minlength=5)
        logs[:-1, k] = np.log((n + 0.5) / (total[of_length] + 0.5 * kinds[of_length]))
    logs[:-1] -= logs[:-1].mean(1, keepdims=True)
    order = np.argsort(keys)
    logs[:-1] = logs[:-1][order]
    return Model(langs, np.array(letters, np.int64), keys[order], logs, allowed)


def train(texts: Iterable[tuple[str, str]]) -> Model:
    """Model of (language, text) rows."""
    return learn(counted(texts))


def remember(m: Model, new: list[str]) -> None:
    """Scores of words not seen before, as further rows of m.table."""
    k = len(m.langs)
    keys, owners = gram_keys(new, m.alphabet)
    at = np.searchsorted(m.keys, keys)
    row = np.where(m.keys[np.minimum(at, len(m.keys) - 1)] == keys, at, len(m.keys)) if len(m.keys) else np.zeros(len(keys), int)
    sums = np.stack([np.bincount(owners, m.logs[row, j], minlength=len(new)) for j in range(k)], 1)
    # Overlapping n-grams count the same letters up to four times.
    score = np.clip((sums - sums.max(1, keepdims=True)) / 3, -MOST, 0)
    allowed = m.allowed[scripts(new)]
    some, all_ = allowed.any(1), allowed.all(1)
    score[~some] = 0
    # Only languages that use the script are candidates; the best of them has 0.
    part = some & ~all_
    best = np.where(allowed[part], sums[part], -np.inf).max(1, keepdims=True)
    score[part] = np.where(allowed[part], np.clip((sums[part] - best) / 3, -MOST, 0), -OUT)
    at = len(m.rows)
    if m.table is None:
        m.table = np.zeros((1024, k), np.float32)
    while at + len(new) > len(m.table):
        m.table = np.concatenate([m.table, np.zeros_like(m.table)])
    m.table[at : at + len(new)] = score
    m.rows.update(zip(new, range(at, at + len(new)), strict=True))


def viterbi(emission: np.ndarray, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Best label of each word. rows: the words' rows of emission; text i has the words first[i]:first[i+1]. All texts step together, the longest the furthest."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    start, size = first[:-1][order], size[order]
    k = emission.shape[1]
    back = np.zeros((len(rows), k), np.uint8)
    live = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), "left")  # texts with a word at step t
    label = np.zeros(len(rows), np.uint8)
    score = np.zeros((len(size), k), np.float32)
    own = np.arange(k, dtype=np.uint8)
    for t, n in enumerate(live):
        at = start[:n] + t
        s = score[:n]
        top = s.argmax(1).astype(np.uint8)
        best = s.max(1, keepdims=True)
        stay = s >= best - SWITCH
        back[at] = np.where(stay, own, top[:, None])
        score[:n] = np.where(stay, s - best, -SWITCH) + emission[rows[at]]
    current = score.argmax(1).astype(np.uint8)
    for t in range(len(live) - 1, -1, -1):
        at = start[: live[t]] + t
        c = current[: live[t]]
        label[at] = c
        current[: live[t]] = back[at, c]
    return label


def label_batch(m: Model, texts: list[str | None]):
    """For runs of texts: (first text, word counts' bounds, labels, letters, scores of the words)."""
    at = 0
    while at < len(texts):
        words: list[str] = []
        first, begin = [0], at
        if len(m.rows) > REMEMBERED:
            m.rows, m.table = {}, None
        while at < len(texts) and len(words) < STEP_WORDS:
            words += words_of((texts[at] or "").lower())
            first.append(len(words))
            at += 1
        new = list(set(words) - m.rows.keys())
        for i in range(0, len(new), 8192):
            remember(m, new[i : i + 8192])
        r = np.fromiter(map(m.rows.__getitem__, words), np.int64, len(words))
        f, letters = np.array(first, np.int64), np.fromiter(map(len, words), np.int64, len(words))
        table = m.table if m.table is not None else np.zeros((1, len(m.langs)), np.float32)
        yield begin, f, viterbi(table, r, f), letters, table, r


def predict_batch(m: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    names, scores = [], []
    if not m.langs:
        return ["und"] * len(texts), [0.0] * len(texts)
    k = len(m.langs)
    for _, f, label, letters, table, r in label_batch(m, texts):
        n = len(f) - 1
        of = np.repeat(np.arange(n), np.diff(f))
        share = np.bincount(of * k + label, letters, minlength=n * k).reshape(n, k)
        total = share.sum(1)
        evidence = np.stack([np.bincount(of, table[r, j], minlength=n) for j in range(k)], 1).astype(float)
        top = share.argmax(1)
        mine = evidence[np.arange(n), top].copy()
        evidence[np.arange(n), top] = -np.inf
        margin = np.clip(mine - evidence.max(1), -30, 30) if k > 1 else np.full(n, 30.0)
        # Share of the letters, halved at worst where the words' scores speak against it.
        score = share.max(1) / np.maximum(total, 1) * (0.5 + 0.5 / (1 + np.exp(-margin)))
        names += [m.langs[t] if s else "und" for t, s in zip(top, total, strict=True)]
        scores += np.where(total > 0, score, 0.0).tolist()
    return names, scores


def spans_batch(m: Model, texts: list[str | None]) -> list[list[dict]]:
    """Runs of words in one language: first word, words, letters and language."""
    out = []
    for _, f, label, letters, _, _ in label_batch(m, texts):
        for a, b in zip(f[:-1], f[1:], strict=True):
            cuts = np.flatnonzero(np.diff(label[a:b])) + 1 if b > a else np.zeros(0, int)
            bounds = [0, *cuts.tolist(), int(b - a)] if b > a else [0]
            out.append([{"first_word": i, "n_words": j - i, "n_letters": int(letters[a + i : a + j].sum()), "lang": m.langs[label[a + i]]} for i, j in zip(bounds[:-1], bounds[1:], strict=True)])
    return out


def fit(docs: DataFrame, usable=None) -> Model:
    """Trains on a bounded sample of the rows with a language, chosen by a hash of id and text."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    if usable is not None:
        rows = rows.where(usable)
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return train([])
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, min(1.0, SAMPLE_PER_LANG / n)).otherwise(share)
    chance = F.pmod(F.xxhash64("doc_id", "text", F.lit(17)), F.lit(1 << 20)) / float(1 << 20)
    schema = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                columns = list(zip(*counted(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)), strict=True)) or [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    grams = mapped(rows.where(chance < share).select(F.col("lang").cast("string"), "text"), count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # Each language has its share of the model, so that none with few texts loses its n-grams to others.
    by_count = Window.partitionBy("lang").orderBy((F.substring("gram", 1, 1) != "=").cast("int"), F.desc("n"), "gram")
    got = grams.withColumn("place", F.row_number().over(by_count)).where(F.col("place") <= max(1, MOST_GRAMS // len(counts))).orderBy("lang", "place").toArrow()
    return learn(zip(*(got[c].to_pylist() for c in ("lang", "gram", "n")), strict=True))


def _mapper(model, schema: pa.Schema, rows):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = replace(model.value, rows={}, table=None)  # what a task remembers goes with it
        for batch in batches:
            for part in slices(batch, 1, 5000, 4 << 20):
                got = rows(m, part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(v, f.type) for v, f in zip(got, list(schema)[1:], strict=True))], schema=schema)

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # MOST_GRAMS rows at most
    return mapped(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), _mapper(shared, schema, predict_batch), "doc_id long, lang_pred string, score double")


def label_spans(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and the language spans of every document."""
    span = pa.struct([("first_word", pa.int64()), ("n_words", pa.int64()), ("n_letters", pa.int64()), ("lang", pa.string())])
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(span))])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = lambda m, texts: [spans_batch(m, texts) if m.langs else [[] for _ in texts]]
    return mapped(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), _mapper(shared, schema, rows), "doc_id long, spans array<struct<first_word:long,n_words:long,n_letters:long,lang:string>>")


def keep(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """The documents, all columns as they are, whose language is known with the least score."""
    at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = replace(shared.value, rows={}, table=None)
        for batch in batches:
            for part in slices(batch, at, 5000, 4 << 20):
                names, scores = predict_batch(m, part.column(at).to_pylist())
                yield part.filter(pa.array([n != "und" and s >= least for n, s in zip(names, scores, strict=True)], pa.bool_()))

    return mapped(docs, run, docs.schema)


def op3_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, fold("doc_id", 3) != 1)
    return predict(docs, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
