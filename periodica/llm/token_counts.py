"""Token counts under a unigram model, by dynamic programming shared along a trie.

A text is parted into pre-tokens by the tokenizer's pattern; the tokens of a pre-token are its best
segmentation into vocabulary pieces. The best score of every prefix depends on the prefix alone, so the
distinct pre-tokens go into a trie and the forward step runs once for each node: a prefix that many words
share is scored once. The node where a pre-token ends stores its count.

The vocabulary is that of a public byte-level tokenizer; nothing is trained. A piece of rank r among the
pieces of several bytes has the probability of a Zipf-Mandelbrot law, (r + 2.7)^-1, normalised; single bytes, the fallback
for anything, have the last rank. Of segmentations with equal scores the one with fewer tokens counts.

One pass over the documents, no shuffle: each Python worker fills a trie of its own, task after task. At ``MAX_NODES`` nodes the
prefixes are emptied and the terminal counts stay; at ``MAX_WORDS`` pre-tokens those are emptied too. That costs time and changes no count.

Defined results: null and empty texts have 0 tokens and 0 pre-tokens; repeated rows are counted each; an empty
table gives no rows; other columns pass through, and one called like an output is replaced.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterable

from pyspark.sql import DataFrame

from periodica.llm.common import per_row

MAX_NODES = 400_000
MAX_WORDS = 500_000


def read_ranks(path: str) -> list[bytes]:
    """Pieces of a ranks file (base64 of a piece and its rank on each line), by rank."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    return [base64.b64decode(piece) for piece, _ in sorted(pairs, key=lambda p: int(p[1]))]


def piece_scores(pieces: Iterable[bytes]) -> dict[bytes, float]:
    """Log probability of each piece."""
    pieces = list(pieces)
    several = [p for p in pieces if len(p) > 1]
    weight = {p: 1 / (r + 2.7) for r, p in enumerate(several)}
    weight |= dict.fromkeys((bytes([b]) for b in range(256)), 1 / (len(several) + 2.7))
    norm = math.log(sum(weight.values()))
    return {p: math.log(w) - norm for p, w in weight.items()}


class PieceTrie:
    """The vocabulary as a trie: ``step[node << 8 | byte]`` is the next node, ``score[node]`` a piece's score or None."""

    def __init__(self, scores: dict[bytes, float]):
        self.step: dict[int, int] = {}
        self.score: list[float | None] = [None]
        for piece, score in scores.items():
            node = 0
            for b in piece:
                key = node << 8 | b
                if key not in self.step:
                    self.step[key] = len(self.score)
                    self.score.append(None)
                node = self.step[key]
            self.score[node] = score


class TokenTrie(dict):
    """Pre-tokens with the forward state of each prefix; as a mapping, the terminal counts: tokens of each pre-token.

    ``best`` and ``tokens`` of a node are the score and length of its prefix's best segmentation; ``open`` holds the
    pieces that have begun inside it: vocabulary node, and score and tokens before the piece. A count that is not yet
    known is found on the way (``trie[word]``).
    """

    def __init__(self, pieces: PieceTrie, max_nodes: int = MAX_NODES, max_words: int = MAX_WORDS):
        super().__init__()
        self.pieces, self.max_nodes, self.max_words = pieces, max_nodes, max_words
        self.steps_taken = 0
        self._empty()

    def _empty(self) -> None:
        self.step: dict[int, int] = {}
        self.best, self.tokens = [0.0], [0]
        self.open: list[tuple[tuple[int, float, int], ...]] = [()]

    def __missing__(self, word: str) -> int:
        if len(self.best) > self.max_nodes:
            self._empty()  # the terminal counts stay
        if len(self) >= self.max_words:
            self.clear()
        found = self[word] = self.tokens[self._insert(word.encode("utf-8", "surrogatepass"))]
        return found

    def _insert(self, word: bytes) -> int:
        node, step = 0, self.step
        for b in word:
            key = node << 8 | b
            after = step.get(key)
            if after is None:
                after = step[key] = self._forward(node, b)
            node = after
        return node

    def _forward(self, node: int, b: int) -> int:
        self.steps_taken += 1
        step, score = self.pieces.step.get, self.pieces.score
        begun = []
        best, tokens = -math.inf, 0
        before, used = self.best[node], self.tokens[node]
        piece = step(b)
        if piece is not None:
            begun.append((piece, before, used))
            gain = score[piece]
            if gain is not None:
                best, tokens = before + gain, used + 1
        for piece, before, used in self.open[node]:
            piece = step(piece << 8 | b)
            if piece is None:
                continue
            begun.append((piece, before, used))
            gain = score[piece]
            if gain is not None:
                gain += before
                if gain > best or gain == best and used + 1 < tokens:
                    best, tokens = gain, used + 1
        self.best.append(best)
        self.tokens.append(tokens)
        self.open.append(tuple(begun))
        return len(self.best) - 1


#: The trie of this Python worker, for the vocabulary it was made for: tasks that the worker runs one after the other go on with it.
_TRIES: dict[str, TokenTrie] = {}


def worker_trie(key: str, scores: dict[bytes, float]) -> TokenTrie:
    if key not in _TRIES:
        _TRIES.clear()
        _TRIES[key] = TokenTrie(PieceTrie(scores))
    return _TRIES[key]


def with_token_counts(
    docs: DataFrame, vocabulary: str, pattern: str, drop: tuple[str, ...] = ()
) -> DataFrame:
    """``docs`` with n_tokens and n_pretokens. ``vocabulary`` is a ranks file the driver reads and broadcasts (about 1 MB)."""
    ranks = read_ranks(vocabulary)
    key = hashlib.sha256(repr(ranks).encode()).hexdigest()
    pieces = docs.sparkSession.sparkContext.broadcast(piece_scores(ranks))

    def make():
        import regex

        find = regex.compile(pattern).findall
        count = worker_trie(key, pieces.value).__getitem__

        def run(texts):
            words = [find(t) if t else () for t in texts]
            return [sum(map(count, w)) for w in words], [len(w) for w in words]

        return run

    return per_row(docs, ["text"], [("n_tokens", "bigint"), ("n_pretokens", "bigint")], make, drop)
