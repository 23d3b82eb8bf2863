import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from fluxlake.llm import packing as K

PATH = P.path("word_bpe_49k.json")


def check_plan(lengths, limit):
    values, counts = np.unique(lengths, return_counts=True)
    p = K.plan(dict(zip(values.tolist(), counts.tolist(), strict=True)), limit)
    size = np.repeat(values, counts).astype(np.int64)
    rank = np.concatenate([np.arange(c) for c in counts]) if len(counts) else np.zeros(0, np.int64)
    seq, off = p.place(size, rank) if len(size) else (rank, rank)
    order = np.lexsort([off, seq])
    s, o, z = seq[order], off[order], size[order]
    new = np.r_[True, s[1:] != s[:-1]] if len(s) else np.zeros(0, bool)
    assert (o[new] == 0).all() and (o[~new] == (o + z)[np.flatnonzero(~new) - 1]).all()
    assert not len(s) or ((o + z).max() <= limit and len(np.unique(s)) == p.sequences)
    return p.sequences


@pytest.mark.parametrize("seed", range(6))
def test_plans_are_gapless_and_tight(seed):
    rng = np.random.default_rng(seed)
    lengths = [rng.integers(1, 100, 500), rng.integers(30, 60, 999), np.full(77, 50), np.r_[rng.integers(1, 9, 300), rng.integers(51, 100, 60)], np.array([100]), np.zeros(0, int)][seed]
    used = check_plan(lengths, 100)
    least = max(-(-int(lengths.sum()) // 100), int((lengths > 50).sum()))
    assert used <= least * 1.2 + 1


def test_linear_grouping_beats_best_fit_on_mid_lengths():
    rng = np.random.default_rng(0)
    values, counts = np.unique(rng.integers(600, 1100, 20_000), return_counts=True)
    c = dict(zip(values.tolist(), counts.tolist(), strict=True))
    assert K.plan(c).sequences < K._plan(c, 2048, 1 / 2, 24).sequences


def test_query_on_edges(edge, edge_rows):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    want = []
    for r in edge_rows:
        ids = np.array(t.encode(r[1] or "", add_special_tokens=False).ids + [0], "<u4").tobytes()
        want += [(r[0] if r[0] is not None else -1, k // 8192, k // 4, len(ids[k : k + 8192]) // 4, zlib.crc32(ids[k : k + 8192])) for k in range(0, len(ids), 8192)]
    out = K.pack(edge, PATH, with_ids=True).collect()
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == sorted(want)
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
    for places in by.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 2048


def test_sequences_hold_their_pieces(documents):
    p = K.pack(documents, PATH, with_ids=True)
    s = K.sequences(p)
    assert s.selectExpr("sum(length(ids)) div 4").first()[0] == p.selectExpr("sum(length)").first()[0]
    assert s.selectExpr("max(length(ids)) div 4").first()[0] <= 2048


def test_empty(empty):
    assert K.pack(empty, PATH).count() == 0


def test_added_tokens_are_ids_in_the_query(spark, tmp_path):
    texts = ["hello <|endoftext|> x", "<|startoftext|>a b<|endoftext|>", "no token here", "a <|ENDOFTEXT|> b\x1cc", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    t = Tokenizer.from_file(PATH)
    want = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, K.SEPARATOR], "<u4").tobytes() for i, x in enumerate(texts)}
    got = {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in K.op7_packing(spark, str(tmp_path)).collect()}
    assert got == {i: (len(v) // 4, zlib.crc32(v)) for i, v in want.items()}


def test_full_tables_keep_what_is_in_use(monkeypatch):
    monkeypatch.setattr(K, "REMEMBERED", 600)
    t, asked = K.Tokens(PATH), []

    class Counted:
        def tokenize(self, p, bpe=t.bpe):
            asked.append(p)
            return bpe.tokenize(p)

    t.bpe = Counted()
    letters = "abcdefghij"
    new = ["".join(letters[int(d)] for d in str(i)) for i in range(4000)]
    texts = [f"Common, common {w}x{w}." for w in new]
    library = Tokenizer.from_file(PATH)
    want = [np.array([*library.encode(x, add_special_tokens=False).ids, K.SEPARATOR], "<u4").tobytes() for x in texts]
    assert t.encode(texts) == want
    assert asked.count("common") == 1 and len(t.known) + len(t.older) < 6000


def test_ends_of_runs_are_pieces_of_their_own():
    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    texts = ["don't's 's' '' a'' I'LL we'Ve. 'T", "ÀÉ..ß!! İx. ſs ª.º é1é. x1.", "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~ a!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", "a_b __ \u00ad a\u00ad. ʰ. ’s it’s ..1"]
    t = K.Tokens(PATH)
    for _ in range(2):  # learned and remembered
        assert t.encode(texts) == [np.array([*library.encode(x, add_special_tokens=False).ids, K.SEPARATOR], "<u4").tobytes() for x in texts]
