"""Benchmark decontamination by a generalised suffix automaton of the test items.

The items' normalised words build one automaton; the words of each document are streamed through it, and
the length of the longest match is tracked. Where it reaches ``window`` words, those words are hit; an
item shorter than the window is hit where it occurs whole. One pass over the documents, no shuffle.

Test sets are small beside a corpus. Their size is measured: an automaton takes at most ``AUTOMATON_BYTES`` of item
text, and a larger test set becomes several automata, built, broadcast and streamed one after the other.

Defined results: null texts have no words and no hits; items without words never occur; repeated items
with one id count once, those without an id as one item of the empty name; empty tables give no rows or no hits; other columns pass through unread, and one
that is called like an output is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from periodica.llm.common import cut, per_row, text_of

AUTOMATON_BYTES = 16 << 20
#: Letters A-Z become small; digits, a-z and every byte beyond ASCII are word bytes, all others part words.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


class ItemAutomaton:
    """Suffix automaton of all items: every path from the root is a run of words of some item."""

    def __init__(self, items: list[tuple[object, str]], window: int):
        self.window = window
        self.word_ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ids = self.word_ids
        sequences = [(item, [ids.setdefault(w, len(ids)) for w in words_of(text)]) for item, text in items]
        sequences = [(item, words) for item, words in sequences if words]
        for _, words in sequences:
            last = 0
            for c in words:
                last = self._extend(last, c)
        owners: list[set] = [set() for _ in self.length]
        whole: list[list[tuple[int, object]]] = [[] for _ in self.length]
        for item, words in sequences:
            state = 0
            for c in words:
                state = self.next[state][c]
                owners[state].add(item)
            if len(words) < window:
                whole[state].append((len(words), item))
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        for s in reversed(order):
            owners[self.link[s]] |= owners[s]
        # gram[s]: the items that hold the window which ends in state s; short[s]: short items that end there.
        self.gram: list[frozenset | None] = [None] * len(self.length)
        self.short: list[list[tuple[int, object]]] = [[] for _ in self.length]
        for s in order:
            up = self.link[s]
            if self.length[s] >= window:
                self.gram[s] = self.gram[up] if self.length[up] >= window else frozenset(owners[s])
            self.short[s] = self.short[up] + whole[s]

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._split(last, c, q)
        new = self._state(length[last] + 1, {})
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return new

    def _state(self, length: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(0)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[clone] = self.link[q]
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Hit spans (first and last word), merged, and the items whose windows occur."""
        ids, nxt, link, length = self.word_ids.get, self.next, self.link, self.length
        gram, short, window = self.gram, self.short, self.window
        spans: list[tuple[int, int]] = []
        items: set = set()
        state = matched = 0
        for j, c in enumerate(map(ids, words)):
            if c is None:
                state = matched = 0
                continue
            while state and c not in nxt[state]:
                state = link[state]
                matched = length[state]
            state = nxt[state].get(c, 0)
            matched = matched + 1 if state else 0
            hit = 0
            if matched >= window:
                hit = window
                items |= gram[state]
            for size, item in short[state]:
                if matched >= size:
                    items.add(item)
                    hit = max(hit, size)
            if hit:
                first = j - hit + 1
                while spans and spans[-1][1] >= first - 1:
                    first = min(first, spans.pop()[0])
                spans.append((first, j))
        return spans, items


def _part_count(items: DataFrame) -> int:
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-total // AUTOMATON_BYTES))


def _automaton(items: DataFrame, part: int, parts: int, window: int) -> ItemAutomaton:
    """The automaton of one part of the items; the driver reads these alone, and holds one part's automaton at a time."""
    own = items.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == part).sort("item", "text")
    return ItemAutomaton([(r.item, r.text) for r in own.toLocalIterator()], window)


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, keep_text: bool = True) -> DataFrame:
    """``docs`` with n_words, ``spans`` (first and last word of each hit run) and ``items`` found, sorted."""
    context = docs.sparkSession.sparkContext
    found = docs.drop("spans", "items")
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), text_of().alias("text")).distinct()
    parts = _part_count(items)
    for k in range(parts):
        shared = context.broadcast(_automaton(items, k, parts, window))

        def make(shared=shared):
            scan = shared.value.scan

            def run(texts):
                all_words = [words_of(t) for t in texts]
                scanned = [scan(w) for w in all_words]
                spans = [[{"first": a, "last": b} for a, b in s] for s, _ in scanned]
                return [len(w) for w in all_words], spans, [sorted(i) for _, i in scanned]

            return run

        fields = [("n_words", "bigint"), (f"_spans_{k}", "array<struct<first:bigint,last:bigint>>"), (f"_items_{k}", "array<string>")]
        last = k == parts - 1
        found = per_row(found, ["text"], fields, make, ("text",) if last and not keep_text else ())
        if not last:
            found = cut(found, "contamination")  # one automaton at a time in a task, too
    spans = F.array_sort(F.flatten(F.array(*(F.col(f"_spans_{k}") for k in range(parts)))))
    items = F.array_sort(F.array_distinct(F.flatten(F.array(*(F.col(f"_items_{k}") for k in range(parts))))))
    one = spans if parts == 1 else F.aggregate(spans, F.array().cast("array<struct<first:bigint,last:bigint>>"), _merge)
    temporary = [f"_{what}_{k}" for what in ("spans", "items") for k in range(parts)]
    return found.withColumns({"spans": one, "items": items}).drop(*temporary)


def _merge(done: F.Column, span: F.Column) -> F.Column:
    """Sorted spans, one after the other: one that touches the last is joined to it."""
    last = F.element_at(done, -1)
    touches = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["last"] >= span["first"] - 1)
    joined = F.struct(last["first"].alias("first"), F.greatest(last["last"], span["last"]).alias("last"))
    return F.when(touches, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(
        F.concat(done, F.array(span))
    )


def count_hits(found: DataFrame) -> DataFrame:
    """n_words, n_hit, n_items, items_sha256 and contaminated of each row of ``find_contamination``."""
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["last"] - s["first"] + 1)
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, min_words: int = 1, max_coverage: float = 0.0
) -> DataFrame:
    """``docs`` without the rows in which some hit run has ``min_words`` words and hits cover over ``max_coverage``."""
    names = [f"_in_{i}" for i, _ in enumerate(docs.columns)]
    renamed = docs.toDF(*names).withColumn("text", F.col(names[docs.columns.index("text")]))
    found = find_contamination(renamed, benchmark, window)
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["last"] - s["first"] + 1)
    long = F.exists("spans", lambda s: s["last"] - s["first"] + 1 >= min_words)
    bad = long & (hit > max_coverage * F.col("n_words"))
    return found.where(~bad).select(*names).toDF(*docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` with the hit words, and what stands between them, cut out of ``text``."""
    names = [f"_in_{i}" for i, _ in enumerate(docs.columns)]
    at = docs.columns.index("text")
    found = find_contamination(docs.toDF(*names).withColumn("text", F.col(names[at])), benchmark, window)

    def make():
        import re

        pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

        def run(texts, spans):
            cleaned = []
            for text, hits in zip(texts, spans, strict=True):
                if not hits:
                    cleaned.append(text)
                    continue
                places = [m.span() for m in pattern.finditer(text)]
                kept, start = [], 0
                for s in hits:
                    kept.append(text[start : places[s["first"]][0]])
                    start = places[s["last"]][1]
                cleaned.append("".join(kept) + text[start:])
            return (cleaned,)

        return run

    cleaned = per_row(found, ["text", "spans"], [("_clean", "string")], make)
    return cleaned.select(*("_clean" if i == at else n for i, n in enumerate(names))).toDF(*docs.columns)
