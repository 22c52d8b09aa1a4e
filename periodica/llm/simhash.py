"""SimHash near-duplicates: pivot distance tables over fingerprints, and their components.

Every document gets a 64-bit fingerprint of its word shingles. Equal fingerprints are one class, so a
group of copies, however large, is one row from here on. Classes are linked where their fingerprints
differ in few bits:

* the *pivot table* holds, for every class, its Hamming distances to ``REFERENCES`` fixed fingerprints;
* two classes meet where they agree in three of seven bit blocks: with four differing bits at most three
  blocks are untouched for certain, so no link is lost, and blocks of 27 bits keep the meetings few;
* a pair is discarded when any coordinate of the pivot table differs by more than the limit (by the
  triangle inequality it cannot be near), and the survivors are verified bit by bit.

Components of the links come from alternating star contractions, a few joins over the links alone.

Joins of classes, links and winners are merged on disk, never broadcast: Spark takes the size of a table from its compressed file and
does not count what an explode makes of it, so that it would send tables many times its threshold through the driver.

Defined results: a null or blank text has fingerprint zero and is linked like any other; rows repeated
with the same id count once for the components and appear as often as they came; a row without an id
joins components but names one only if no member has an id (then ``component_id`` is null); an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from periodica.llm.common import LOWER, cut, per_row, text_of

#: Bits of each of the seven blocks of a fingerprint.
BLOCKS = (10, 9, 9, 9, 9, 9, 9)
#: Reference fingerprints of the pivot table; seven distances fill one 64-bit column.
REFERENCES = 14
NO_ID = (1 << 63) - 1
HASH_SEED = 42


def fingerprint(text: str | None, width: int = 4) -> int:
    """The fingerprint as an unsigned number: a bit is set if it is in over half the shingles' hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, HASH_SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - width + 1]
    digest = xxhash.xxh64_intdigest
    spans = zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)
    hashes = np.fromiter((digest(joined[i:j], HASH_SEED) for i, j in spans), np.uint64, len(starts))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8), bitorder="little")
        counts += bits.reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def with_fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id, ``key`` (a hash of the text) and ``fp`` (signed 64 bits) of every row."""
    narrow = docs.select("doc_id", text_of().alias("text")).withColumn("key", F.xxhash64("text"))

    def make():
        return lambda texts: ([_signed(fingerprint(t, width)) for t in texts],)

    return per_row(narrow, ["text"], [("fp", "bigint")], make, ("text",))


def _references(count: int) -> list[int]:
    return [int(x) for x in np.random.default_rng(7).integers(-(1 << 63), 1 << 63, count, dtype=np.int64)]


def _pivot_columns(fp: str) -> list[F.Column]:
    """Distances to the references, seven to a column, eight bits each."""
    columns = []
    for at in range(0, REFERENCES, 7):
        coordinates = (
            F.shiftleft(F.bit_count(F.col(fp).bitwiseXOR(F.lit(r).cast("bigint"))).cast("bigint"), 8 * i)
            for i, r in enumerate(_references(REFERENCES)[at : at + 7])
        )
        columns.append(reduce(lambda a, b: a.bitwiseOR(b), coordinates).alias(f"pivots_{at // 7}"))
    return columns


def _coordinates_near(a: F.Column, b: F.Column, limit: int) -> F.Column:
    """No byte of ``a`` and ``b`` differs by more than ``limit``: bytes are at most 64, so 128 + difference stays in its byte."""
    high = sum(128 << 8 * i for i in range(7))
    slack = F.lit(sum(limit << 8 * i for i in range(7)))
    high_bits = F.lit(high)
    above = a.bitwiseOR(high_bits) - b + slack
    below = b.bitwiseOR(high_bits) - a + slack
    return above.bitwiseAND(below).bitwiseAND(high_bits) == high_bits


def links(classes: DataFrame, limit: int = 4) -> DataFrame:
    """Pairs ``a < b`` of fingerprints of ``classes`` (column ``fp``) that differ in at most ``limit`` bits."""
    if limit > len(BLOCKS) - 3:
        raise ValueError(f"three of {len(BLOCKS)} blocks are surely equal up to {len(BLOCKS) - 3} bits")
    offsets = [sum(BLOCKS[:i]) for i in range(len(BLOCKS))]
    block = [((1 << n) - 1) << o for n, o in zip(BLOCKS, offsets, strict=True)]
    masks = [_signed(block[i] | block[j] | block[k]) for i, j, k in combinations(range(len(BLOCKS)), 3)]
    keys = F.array(*(F.col("fp").bitwiseAND(F.lit(m).cast("bigint")) for m in masks))
    meeting = classes.select("fp", *_pivot_columns("fp")).select("*", F.posexplode(keys).alias("part", "block"))
    a, b = meeting.alias("a"), meeting.alias("b")
    near = [
        _coordinates_near(F.col(f"a.pivots_{i}"), F.col(f"b.pivots_{i}"), limit) for i in range(REFERENCES // 7)
    ]
    verified = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= limit
    same = (F.col("a.part") == F.col("b.part")) & (F.col("a.block") == F.col("b.block"))
    pairs = a.join(b.hint("merge"), reduce(lambda x, y: x & y, [same, F.col("a.fp") < F.col("b.fp"), *near, verified]))
    return pairs.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")).distinct()


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b), root being the smallest node it reaches.

    Large-star and small-star contractions in turn until nothing changes: the number of turns follows
    the logarithm of a component's diameter, and no component is gathered anywhere.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "edges")
    before = None
    for _ in range(limit):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest.hint("merge"), "u")
        moved = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(moved.union(smallest.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("the components did not settle")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def near_duplicates(docs: DataFrame, width: int = 4, limit: int = 4) -> DataFrame:
    """doc_id, key, fp, component_id and n_links (of the fingerprint, to other fingerprints) of every row."""
    return _rooted(docs, width, limit).drop("root")


def _rooted(docs: DataFrame, width: int, limit: int) -> DataFrame:
    """The columns of ``near_duplicates`` and ``root``, the smallest fingerprint of the component."""
    narrow = cut(with_fingerprints(docs, width), "fingerprints")
    classes = cut(narrow.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    edges = cut(links(classes, limit), "links")
    degrees = edges.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_links"))
    rooted = components(edges).select(F.col("node").alias("fp"), "root")
    linked = cut(classes.join(rooted.hint("merge"), "fp").join(degrees.hint("merge"), "fp"), "linked")
    first = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    members = linked.join(first.hint("merge"), "root").select("fp", "root", "component_id", "n_links")
    alone = classes.join(members.hint("merge"), "fp", "left_anti").select(
        "fp", F.col("fp").alias("root"), F.col("first").alias("component_id"), F.lit(0).cast("bigint").alias("n_links")
    )
    return narrow.join(cut(members.union(alone), "members").hint("merge"), "fp", "left")


def keep_one_each(docs: DataFrame, width: int = 4, limit: int = 4) -> DataFrame:
    """The rows of ``docs`` with one document of each component: the smallest id, rows without id last."""
    return keep_winners(docs, _rooted(docs, width, limit).select("doc_id", "key", "root"))


def keep_winners(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` that win their component, given ``found`` (doc_id, key, root): the smallest id, rows without id last.

    Rows that repeat an id and its text are one document.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "key")).alias("first")
    chosen = found.groupBy("root").agg(first).select(F.col("first.doc_id").alias("won_id"), F.col("first.key").alias("won_key"))
    winners = cut(chosen, "winners")
    # Columns of the documents go by position, so that they may have any names.
    names = [f"_in_{i}" for i in range(len(docs.columns))]
    doc, text = (F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text"))
    keyed = docs.toDF(*names).withColumn("key", F.xxhash64(F.coalesce(text.cast("string"), F.lit(""))))
    kept = keyed.join(winners.hint("merge"), doc.eqNullSafe(F.col("won_id")) & (F.col("key") == F.col("won_key")), "left_semi")
    return kept.dropDuplicates([names[docs.columns.index("doc_id")], "key"]).select(*names).toDF(*docs.columns)
