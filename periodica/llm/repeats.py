"""Removal of repeated substrings by longest-previous-factor arrays.

A byte goes if a string of ``SPAN`` bytes that covers it also starts in a document with a smaller id. So what is wanted of
the longest-previous-factor array is where it reaches ``SPAN``, the factor being that of an earlier document.

One suffix array over a corpus fits nowhere; suffixes cut at ``SPAN`` bytes can be parted. Every window of
``SPAN`` bytes has a minimiser, the smallest hash of its ``FACTOR``-byte factors, which depends on its content alone; equal
windows share it. Runs of neighbouring windows with one minimiser travel as one string (about three bytes for
each byte of text, compressed), and a bucket of minimisers is a task's work:

* runs whose minimiser occurs in one document only are dropped, equal runs are folded to one with its earliest document;
* the windows of the rest are put into suffix order, equal windows by document. Where neighbours share ``SPAN`` bytes, the
  previous smaller document of a suffix lies at the start of its stretch of equal windows, and the next smaller one
  nowhere after it: that gives the array at once;
* windows with an earlier match give byte ranges of their document.

The ranges meet their texts by document id, are united, and the rest is kept. A passage that a third of the
documents share costs its bucket one short entry for each document and one string for each task it was read by, not pairs.

Defined results: null texts are empty; a text below ``SPAN`` bytes loses nothing; rows that repeat an id are documents none
of which is smaller than the other, whatever their texts; a row without an id comes after all ids; an
empty table gives no rows; other columns pass by and one called like an output is replaced.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from periodica.llm.common import cut

SPAN = 50
FACTOR = 8
NO_ID = (1 << 63) - 1
#: Text that is cut into runs at a time; a longer text is cut in pieces that overlap by a window less a byte.
CHUNK_BYTES = 4 << 20
PIECE_BYTES = 2 << 20
#: Bytes of runs in a bucket, before compression.
BUCKET_BYTES = 8 << 20
#: Windows that are sorted at a time.
SORT_WINDOWS = 400_000
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _window_minimisers(data: np.ndarray, span: int) -> np.ndarray:
    """For each window of ``span`` bytes the smallest hash of a factor in it. ``data`` has at least ``span`` bytes."""
    padded = data.tobytes() + bytes(8)
    n = len(data) - FACTOR + 1
    value = np.ndarray((n,), "<u8", buffer=padded, strides=(1,)) * _ODD
    value ^= value >> np.uint64(29)
    value *= _MIX
    value ^= value >> np.uint64(32)
    width, done = span - FACTOR + 1, 1
    while done * 2 <= width:
        value = np.minimum(value[:-done], value[done:])
        done *= 2
    if done < width:
        value = np.minimum(value[: done - width], value[width - done :])
    return value


def cut_runs(docs: list[tuple[int, int, int, bytes]], buckets: int, span: int = SPAN) -> Iterator[tuple[int, bytes]]:
    """(bucket, packed runs) of documents given as (id, tag, offset of the piece, bytes of at least ``span``)."""
    data = np.frombuffer(b"".join(d[3] for d in docs), np.uint8)
    sizes = np.array([len(d[3]) for d in docs])
    begins = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(docs), dtype=np.int32), sizes)
    least = _window_minimisers(data, span)
    n = len(least)
    inside = owner[:n] == owner[span - 1 :]
    change = np.concatenate(([True], (least[1:] != least[:-1]) | (owner[1:n] != owner[: n - 1])))
    starts = np.flatnonzero(change & inside)
    # A run ends before the next change or before the windows that leave the document.
    edges = np.flatnonzero(change | ~inside)
    after = np.append(edges, n)[np.searchsorted(edges, starts, side="right")]
    lengths = after - starts + span - 1
    key = least[starts] * _ODD
    del least, change, inside, edges, after
    bucket = ((key >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    starts, lengths, bucket, key = starts[order], lengths[order], bucket[order], key[order]
    who = owner[starts]
    ids = np.array([d[0] for d in docs], np.int64)[who]
    tags = np.array([d[1] for d in docs], np.int64)[who]
    at = starts - begins[who] + np.array([d[2] for d in docs], np.int64)[who]
    small = (key & np.uint64(0xFFFFFF)).astype(np.int64)
    pack = zstandard.ZstdCompressor(level=6).compress
    cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else []
    for a, b in zip(cuts, [*cuts[1:], len(bucket)], strict=True):
        size = lengths[a:b]
        ends = np.cumsum(size)
        text = data[np.repeat(starts[a:b] - (ends - size), size) + np.arange(int(ends[-1]))]
        heads = _planes(np.diff(ids[a:b], prepend=0), 8) + _planes(at[a:b], 8) + _planes(size, 4) + _planes(small[a:b], 3)
        yield int(bucket[a]), int(b - a).to_bytes(4, "little") + pack(heads + _planes(tags[a:b], 8) + text.tobytes())


def _planes(values: np.ndarray, width: int) -> bytes:
    """The ``width`` low bytes of each number, all lowest bytes first: equal bytes stand together for the compressor."""
    return values.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _numbers(raw: bytes, n: int, width: int) -> np.ndarray:
    full = np.zeros((n, 8), np.uint8)
    full[:, :width] = np.frombuffer(raw, np.uint8, width * n).reshape(width, n).T
    return full.view("<i8")[:, 0]


def unpack_runs(packed: bytes):
    """ids, tags, places, lengths, small keys and text of ``cut_runs``."""
    n = int.from_bytes(packed[:4], "little")
    raw = zstandard.ZstdDecompressor().decompress(packed[4:])
    at, found = 0, []
    for width in (8, 8, 4, 3, 8):
        found.append(_numbers(raw[at : at + width * n], n, width))
        at += width * n
    ids, places, lengths, small, tags = found
    return np.cumsum(ids), tags, places, lengths, small, raw[at:]


def previous_documents(windows: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """The smallest document among equal windows; ``windows`` are fixed-size byte strings, ``docs`` ascend.

    In suffix order, equal windows by document, the stretch of windows that share all their bytes begins with it.
    """
    order = np.argsort(windows, kind="stable")
    sorted_windows = windows[order]
    shared = np.concatenate(([False], sorted_windows[1:] == sorted_windows[:-1]))  # common prefix of a whole window
    first = np.maximum.accumulate(np.where(shared, 0, np.arange(len(order))))
    previous = np.empty_like(docs)
    previous[order] = docs[order][first]
    return previous


def bucket_ranges(packed: list[bytes], span: int = SPAN) -> tuple[np.ndarray, ...]:
    """ids, tags, first bytes and ends of the byte ranges that have an earlier match, from all runs of a bucket."""
    parts = [unpack_runs(p) for p in packed]
    ids, tags, at, lengths, small = (np.concatenate([p[i] for p in parts]) for i in range(5))
    owner = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    inside = np.concatenate([np.cumsum(p[3], dtype=np.int64) - p[3] for p in parts])
    # Runs whose minimiser is in several documents.
    order = np.lexsort((ids, small))
    s, d = small[order], ids[order]
    group = np.cumsum(np.concatenate(([True], s[1:] != s[:-1]))) - 1
    heads = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    tails = np.append(heads[1:], len(s)) - 1
    order = order[(d[heads] != d[tails])[group]]
    order = order[np.argsort(ids[order], kind="stable")]
    # Equal runs become one, of the earliest document; members in document order.
    number: dict[bytes, int] = {}
    which = np.empty(len(order), np.int64)
    for k, r in enumerate(order.tolist()):
        low = inside[r]
        run = parts[owner[r]][5][low : low + lengths[r]]
        which[k] = number.setdefault(run, len(number))
    runs = list(number)
    del parts, number
    ids, tags, at, lengths = ids[order], tags[order], at[order].astype(np.int64), lengths[order].astype(np.int64)
    first_member = np.zeros(len(runs), np.int64)
    first_member[which[::-1]] = np.arange(len(order))[::-1]
    later = ids > ids[first_member][which] if len(order) else np.zeros(0, bool)
    out = [(ids[later], tags[later], at[later], at[later] + lengths[later])]
    # The others of a run are of its earliest document: their windows may still occur in an earlier one.
    owners = ids[first_member] if len(runs) else np.zeros(0, np.int64)
    sizes = np.array([len(r) for r in runs], np.int64)
    total = np.cumsum(sizes - span + 1)
    previous = np.empty(int(total[-1]) if len(runs) else 0, np.int64)
    # Windows are sorted by stretches of the alphabet of their group's runs: equal windows have equal minimisers.
    key = small[order][first_member] if len(runs) else np.zeros(0, np.int64)
    by_key = np.argsort(key, kind="stable")
    lo = 0
    while lo < len(by_key):
        hi, count = lo, 0
        while hi < len(by_key) and (hi == lo or count < SORT_WINDOWS or key[by_key[hi]] == key[by_key[hi - 1]]):
            count += int(sizes[by_key[hi]]) - span + 1
            hi += 1
        some = np.sort(by_key[lo:hi])  # runs are numbered in document order
        text = np.frombuffer(b"".join([runs[i] for i in some]), np.uint8)
        begins = np.cumsum(sizes[some]) - sizes[some]
        n = sizes[some] - span + 1
        place = np.repeat(begins - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        windows = np.lib.stride_tricks.sliding_window_view(text, span)[place].copy().view(f"S{span}")[:, 0]
        found = previous_documents(windows, np.repeat(owners[some], n))
        target = np.repeat((total[some] - n) - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        previous[target] = found
        lo = hi
    hit = previous < np.repeat(owners, sizes - span + 1)
    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    opens, closes = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # Stretches are split where one run ends and the next begins.
    bounds = np.concatenate(([0], total))
    inner = bounds[1:-1]
    inner = inner[hit[inner] & hit[inner - 1]]
    opens, closes = np.sort(np.concatenate((opens, inner))), np.sort(np.concatenate((closes, inner)))
    run_of = np.searchsorted(total, opens, side="right")
    from_, to = opens - bounds[run_of], closes - bounds[run_of] + span - 1
    early = np.flatnonzero(~later)
    if len(opens) and len(early):
        by_run = np.argsort(which[early], kind="stable")
        early = early[by_run]
        low, high = np.searchsorted(which[early], run_of), np.searchsorted(which[early], run_of, side="right")
        times = high - low
        member = early[np.repeat(low - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))]
        a, b = np.repeat(from_, times), np.repeat(to, times)
        out.append((ids[member], tags[member], at[member] + a, at[member] + b))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _pieces(doc: int, tag: int, text: bytes, span: int):
    for at in range(0, max(1, len(text) - span + 1), PIECE_BYTES - span + 1):
        yield doc, tag, at, text[at : at + PIECE_BYTES]


def _repeats_ids(docs: DataFrame) -> bool:
    """Whether some rows share an id; only the ids are read."""
    return docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() > 0


def _narrow(docs: DataFrame, tagged: bool) -> DataFrame:
    """doc, tag and text in bytes. The tag is a 64-bit hash of the text where ids are repeated, so that rows of one id are told apart, else 0."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc"),
        (F.xxhash64(text) if tagged else F.lit(0).cast("bigint")).alias("tag"),
        text.cast("binary").alias("text"),
    )


def earlier_ranges(docs: DataFrame, span: int = SPAN, tagged: bool = True) -> DataFrame:
    """(doc, tag, first, end): byte ranges whose windows occur in a document with a smaller id. Ranges may overlap."""
    narrow = _narrow(docs, tagged).where(F.octet_length("text") >= span)
    total = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(64, math.ceil(total * 3.2 / BUCKET_BYTES))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            rows = list(cut_runs(held, buckets, span))
            return pa.RecordBatch.from_pydict(
                {"bucket": pa.array([r[0] for r in rows], pa.int32()), "runs": pa.array([r[1] for r in rows], pa.binary())}
            )

        for batch in batches:
            columns = (batch.column(c) for c in ("doc", "tag", "text"))
            for doc, tag, text in zip(*columns, strict=True):
                for piece in _pieces(doc.as_py(), tag.as_py(), text.as_py(), span):
                    held.append(piece)
                    size += len(piece[3])
                    if size >= CHUNK_BYTES:
                        yield flush()
                        held.clear()
                        size = 0
        if held:
            yield flush()

    def match(table: pa.Table) -> pa.Table:
        ids, tags, first, end = bucket_ranges(table.column("runs").to_pylist(), span)
        return pa.table({"doc": ids, "tag": tags, "first": first, "end": end})

    runs = narrow.mapInArrow(spread, "bucket int, runs binary")
    return runs.groupBy("bucket").applyInArrow(match, "doc bigint, tag bigint, first bigint, end bigint")


def merged(spans: np.ndarray) -> list[tuple[int, int]]:
    """Sorted, disjoint and not touching: the union of (first, end) rows."""
    if not len(spans):
        return []
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.flatnonzero(np.concatenate(([True], spans[1:, 0] > reach[:-1])))
    return list(zip(spans[new, 0].tolist(), reach[np.append(new[1:], len(spans)) - 1].tolist(), strict=True))


def remove_repeats(docs: DataFrame, span: int = SPAN, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row; with ``keep_text`` also ``kept``, its remaining bytes."""
    tagged = _repeats_ids(docs)
    ranges = cut(earlier_ranges(docs, span, tagged), "ranges")
    listed = ranges.groupBy("doc", "tag").agg(F.collect_list(F.struct("first", "end")).alias("ranges"))

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            packed = [pack(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("tag"), pa.array(packed, pa.binary())], ["doc", "tag", "packed"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows = []
            for doc, packed, spans in zip(*(batch.column(c) for c in ("doc", "packed", "ranges")), strict=True):
                text = unpack(packed.as_py())
                values = spans.values
                pairs = merged(np.stack([values.field("first").to_numpy(), values.field("end").to_numpy()], 1)) if values is not None else []
                kept, at = [], 0
                for a, b in pairs:
                    kept.append(text[at:a])
                    at = b
                rest = b"".join(kept) + text[at:]
                doc = doc.as_py()
                rows.append((None if doc == NO_ID else doc, len(text), len(text) - len(rest), len(pairs), hashlib.sha256(rest).hexdigest(), rest))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)][: 6 if keep_text else 5]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(arrays)])

    packed = _narrow(docs, tagged).mapInArrow(squeeze, "doc bigint, tag bigint, packed binary")
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * keep_text
    return packed.join(listed, ["doc", "tag"], "left").select("doc", "packed", "ranges").mapInArrow(finish, schema)
