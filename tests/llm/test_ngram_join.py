import random
import re

import pytest

from fluxlake.llm import ngram_join as J

SCHEMA = "doc_id long, text string"


def brute(rows):
    up = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(up))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r[0])
    return sorted((r[0], len(sets[i]), min(groups[find(i)])) for i, r in enumerate(rows))


def got(spark, rows):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect())


def corpus(seed, n=150):
    rng = random.Random(seed)
    stock = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(500)]
    passage = [rng.choice(stock) for _ in range(60)]
    rows, texts = [], []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.45:  # a near copy, at all distances around the threshold, also of near copies
            w = list(rng.choice(texts))
            for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 6])):
                w[rng.randrange(len(w))] = rng.choice(stock)
            if rng.random() < 0.3:
                w += [rng.choice(stock) for _ in range(rng.randint(1, 12))]
        else:
            w = [rng.choice(stock) for _ in range(rng.choice([1, 3, 5, 6, 20, 80, 150]))]
            if kind > 0.7:
                w = w[: len(w) // 2] + passage + w[len(w) // 2 :]
        texts.append(w)
        rows.append((rng.randrange(10**9), " ".join(w)))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_all_links_of_random_corpora(spark, seed):
    rows = corpus(seed)
    assert got(spark, rows) == brute(rows)


def test_small_blocks_and_a_bad_order_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 4)
    monkeypatch.setattr(J, "FREQUENT_MOST", 5)
    rows = corpus(9, 120)
    assert got(spark, rows) == brute(rows)


def test_frequent_tokens_that_do_not_wait_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(J, "WAIT", 2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = corpus(9, 120)
        assert got(spark, rows) == brute(rows)
        made = J._shared_tokens(spark.createDataFrame([(s, 9, [t for t in range(1, 8) if s % t == 0]) for s in [*range(1, 40), *range(1, 40)]], "s long, n long, prefix array<long>"))
        want = sorted((t, s, 9, 39 // t) for t in range(1, 8) for s in range(t, 40, t))
        assert sorted(tuple(r) for r in made.select("token", "s", "n", "df").collect()) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_the_matrix_alone_finds_every_link(spark, monkeypatch):
    monkeypatch.setattr(J, "_within", lambda t, p: (t["s"].to_numpy()[:0], t["s"].to_numpy()[:0]))
    rows = corpus(4, 120)
    assert got(spark, rows) == brute(rows)


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(600):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        rows.append((i + 1, " ".join(w)))
    rows += [(1000 + i, " ".join(base)) for i in range(300)]
    assert got(spark, rows) == brute(rows)


def test_edges(spark, edge, edge_rows, empty):
    rows = [(r[0], r[1]) for r in edge_rows if r[0] is not None]
    out = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.jaccard_components(edge.where("doc_id is not null")).collect())
    assert out == brute(rows)
    assert J.jaccard_components(edge).count() == len(edge_rows)
    assert J.jaccard_components(empty).count() == 0


def test_one_of_each_group_stays(spark):
    rows = [(3, "a b c d e f"), (1, "A B C D E F"), (2, "other words are here now"), (4, None), (5, "")]
    assert sorted(r["doc_id"] for r in J.keep_first(spark.createDataFrame(rows, SCHEMA)).collect()) == [1, 2, 4, 5]


def test_a_repeated_row_stays_once(spark):
    rows = [(3, "a b c d e f", "x"), (3, "a b c d e f", "x"), (3, "A b c  d e f", "y"), (3, "quite another text of six", "x"), (4, None, "x"), (4, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, said string")
    kept = J.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], (r["text"] or "").lower().split()[:1]) for r in kept.collect()) == [(3, ["a"]), (3, ["quite"]), (4, [])]


def test_rows_go_by_their_own_words(spark):
    a, b, c = "one two three four five six seven", "quite another text of some seven words", "a third one that is like nothing else"
    rows = [(1, a), (5, a), (5, b), (5, b + " "), (None, a), (None, a), (None, c), (None, c.upper()), (7, None), (None, None), (None, ""), (9, c + " nor one more word of these nine here")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    kept = sorted(((r["doc_id"], (r["text"] or "").strip().lower()) for r in J.keep_first(docs).collect()), key=repr)
    assert kept == sorted([(1, a), (5, b), (None, c), (7, ""), (None, ""), (9, rows[-1][1])], key=repr)
    near = spark.createDataFrame([(None, a), (3, a), (4, b)], SCHEMA)
    assert sorted(r["doc_id"] for r in J.keep_first(near).collect()) == [3, 4]
