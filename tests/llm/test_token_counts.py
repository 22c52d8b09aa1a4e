from __future__ import annotations

import math

import pytest
import regex

from periodica.llm import token_counts as T
from tests.llm.frames import SMALL, needs_tables, no_documents, odd_documents

PIECES = [bytes([b]) for b in range(256)] + [b"on", b"one", b" tw", b"o ", b"two", b"ab", b"abc", b"bc", b"cd", b" one"]
PATTERN = r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"


def slow_count(word: bytes, scores: dict[bytes, float]) -> int:
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(word)
    for end in range(1, len(word) + 1):
        options = [
            (best[start][0] + scores[word[start:end]], -best[start][1] - 1)
            for start in range(end)
            if word[start:end] in scores
        ]
        gain, used = max(options)
        best[end] = gain, -used
    return best[-1][1]


def test_counts_equal_those_of_each_word_alone():
    scores = T.piece_scores(PIECES)
    trie = T.TokenTrie(T.PieceTrie(scores), max_nodes=40)
    for word in ["one", "onet", "abcd", "abc", "ab", " two", " one", "ononone", "ÄÖ", "zzz", "one", "twoabcd"] * 3:
        assert trie[word] == slow_count(word.encode(), scores), word


def test_shared_prefixes_are_scored_once():
    trie = T.TokenTrie(T.PieceTrie(T.piece_scores(PIECES)))
    for word in ["abcde", "abcdf", "abc", "abcde"]:
        trie[word]
    assert trie.steps_taken == 6


def write_ranks(path, pieces):
    import base64

    path.write_text("".join(f"{base64.b64encode(p).decode()} {r}\n" for r, p in enumerate(pieces)))
    return str(path)


def test_odd_frames(spark, tmp_path):
    path = write_ranks(tmp_path / "ranks", PIECES)
    got = {(r.doc_id, r.text): (r.n_tokens, r.n_pretokens) for r in T.with_token_counts(odd_documents(spark), path, PATTERN).collect()}
    scores = T.piece_scores(PIECES)
    for (_, text), counts in got.items():
        words = regex.findall(PATTERN, text or "")
        assert counts == (sum(slow_count(w.encode(), scores) for w in words), len(words))
    empty = T.with_token_counts(no_documents(spark), path, PATTERN)
    assert empty.count() == 0 and dict(empty.dtypes)["n_tokens"] == "bigint"


@needs_tables
def test_query(spark):
    from periodica.llm.queries import op1_unigram_token_counts

    P = pytest.importorskip("public_tokenizers")
    scores = T.piece_scores(T.read_ranks(P.path("byte_bpe_50k.tiktoken")))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = op1_unigram_token_counts(spark, SMALL).collect()
    assert len(rows) == len(texts)
    known = {}
    for r in rows:
        words = regex.findall(P.PATTERN, texts[r.doc_id])
        for w in words:
            if w not in known:
                known[w] = slow_count(w.encode(), scores)
        assert (r.n_tokens, r.n_pretokens) == (sum(map(known.get, words)), len(words))


def test_emptied_tries_count_alike():
    scores = T.piece_scores(PIECES)
    whole, small = T.TokenTrie(T.PieceTrie(scores)), T.TokenTrie(T.PieceTrie(scores), max_nodes=3, max_words=2)
    words = ["abab", "abc", "b", "abab", "", "cabab", "abc", "é"] * 3
    assert [whole[w] for w in words] == [small[w] for w in words]
    assert len(small) <= 2 and whole.steps_taken < small.steps_taken
