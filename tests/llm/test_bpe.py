import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from fluxlake.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def test_random_strings_match_the_library(reference):
    c, rng = bpe.Codec(PATH, P.PATTERN), random.Random(2)
    for alphabet in ("ab \n\t'sé€ 漢字12.,!́ ", "aA zZ\n", "".join(map(chr, range(1, 500)))):
        for _ in range(3000):
            s = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
            ids = c.encode(s)
            assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(s), repr(s)
            assert c.decode(ids).decode() == s


def test_a_long_piece(reference):
    c, s = bpe.Codec(PATH, P.PATTERN), "ab" * 30_000
    assert np.frombuffer(c.encode(s), "<u4").tolist() == reference.encode_ordinary(s)


def test_leftmost_of_equal_ranks_first():
    ranks = {bytes([i]): i for i in range(256)} | {b"aa": 256, b"aaa": 257}
    assert bpe.merge(b"aaaaa", ranks) == [256, 257] or bpe.merge(b"aaaaa", ranks) == [256, 256, 97]
    reference = tiktoken.Encoding("t", pat_str=".+", mergeable_ranks=ranks, special_tokens={})
    assert bpe.merge(b"aaaaa", ranks) == reference.encode_ordinary("aaaaa")


def test_emptied_tables_change_nothing(reference, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    c, s = bpe.Codec(PATH, P.PATTERN), "the quick brown fox jumps over the lazy dog and the quick cat"
    assert np.frombuffer(c.encode(s), "<u4").tolist() == reference.encode_ordinary(s)


def test_query_on_edges(edge, edge_rows, reference):
    got = sorted((r[0] if r[0] is not None else -1, r[1], r[2], r[3]) for r in bpe.digests(edge, PATH, P.PATTERN).collect())

    def row(i, t):
        ids = reference.encode_ordinary(t or "")
        return (i if i is not None else -1, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())

    assert got == sorted(row(r[0], r[1]) for r in edge_rows)


def test_round_trip_of_columns(documents):
    ids = bpe.encode(documents, PATH, P.PATTERN)
    back = {r["doc_id"]: r["text"] for r in bpe.decode(ids, PATH, P.PATTERN).collect()}
    assert back == {r["doc_id"]: r["text"] or "" for r in documents.collect()}


def test_empty(empty):
    assert bpe.digests(empty, PATH, P.PATTERN).count() == 0
