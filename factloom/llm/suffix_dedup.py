"""Repeated byte strings: every byte that a string of min_bytes covers that also starts elsewhere is removed.

Where to look: each window of min_bytes bytes has an anchor, the smallest-hashed run of anchor_bytes bytes in
it. Equal windows have equal anchors at equal offsets, so only windows whose anchor occurs twice can repeat.
Neighbouring windows with one anchor occurrence form a hull, the bytes that they cover. Equal hulls settle
all their windows; the distinct hulls of one anchor are searched together.

The search: the hulls of some anchors are laid end to end and their Burrows-Wheeler transform is extended
backwards, breadth first, from the empty string. At depth d each interval is the set of suffixes that begin
with one string of d symbols; an interval's right end gets the common-prefix length d - 1 if it has none yet,
and goes on, else it stops. Lengths are thus derived by increasing value, and the search ends at min_bytes:
neighbouring suffixes whose length is still unknown share min_bytes bytes or more. Suffixes are sorted as far
as the search goes.

Anchors whose distinct hulls exceed group_bytes together (passages with thousands of surroundings) aren't
brought together: their windows are counted by hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import hashing as H
from .common import bounded_batches, written

U = np.uint64
HIGH = U(0xFFFFFFFF00000000)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours."""
    n = len(x)
    pad = -n % w
    y = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    up = np.minimum.accumulate(y, axis=1).ravel()
    down = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(down[: n - w + 1], up[w - 1 : n])


def _hulls(buf: np.ndarray, offsets: np.ndarray, size: int, k: int):
    """(row, anchor hash, hull hash, start in the row, length) of every hull of a slice."""
    none = np.zeros(0, np.int64)
    if len(buf) < size:
        return none, none, none, none, none
    sums = H.prefix_sums(buf)
    at = np.arange(len(buf) - k + 1)
    gram = H.run_hash(sums, at, at + k)
    least = (_sliding_min((gram & HIGH) | at.astype(U), size - k + 1) & ~HIGH).astype(np.int64)
    begin, count = offsets[:-1], np.maximum(np.diff(offsets) - size + 1, 0)
    row = np.repeat(np.arange(len(count)), count)
    start = np.repeat(begin - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    if not len(start):
        return none, none, none, none, none
    anchor = least[start]
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(start)]]) - 1
    s, e = start[first], start[last] + size
    return row[first], gram[anchor[first]].view(np.int64), H.run_hash(sums, s, e).view(np.int64), s - begin[row[first]], e - s


def _anchored(size: int, k: int):
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at, n, buf, offsets in H.text_slices(batch.column(2).fill_null("")):
                row, h, hull, start, length = _hulls(buf, offsets, size, k)
                take = pa.array(row + at)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(h), pa.array(hull), pa.array(start), pa.array(length)], ["kd", "kh", "h", "hull", "start", "len"])

    return batches


def _suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes ordered by their first depth symbols at least (prefix doubling)."""
    n = len(symbols)
    rank = symbols.astype(np.int64)
    k = 1
    for _ in range(2):  # three doublings' worth of symbols fit in one key at first
        far = np.zeros(n, np.int64)
        far[: max(0, n - k)] = rank[k:] + 1
        rank = rank * (int(rank.max()) + 2) + far
        k *= 2
    _, rank = np.unique(rank, return_inverse=True)
    while k < depth and int(rank.max()) < n - 1:
        far = np.zeros(n, np.int64)
        far[: max(0, n - k)] = rank[k:] + 1
        _, rank = np.unique(rank * (n + 1) + far, return_inverse=True)
        k *= 2
    return np.argsort(rank, kind="stable")


def repeated_starts(symbols: np.ndarray, length: int) -> np.ndarray:
    """Which suffixes share a prefix of length symbols or more with another one. The last symbol is the smallest, and the only one of its kind."""
    n = len(symbols)
    order = _suffix_order(symbols, length + 1)
    bwt = symbols[order - 1]
    by_symbol = np.argsort(bwt, kind="stable")
    lf = np.empty(n, np.int64)
    lf[by_symbol] = np.arange(n)
    # the next and the previous position of the same symbol
    after, before = np.full(n, n, np.int64), np.full(n, -1, np.int64)
    same = bwt[by_symbol[1:]] == bwt[by_symbol[:-1]]
    after[by_symbol[:-1][same]] = by_symbol[1:][same]
    before[by_symbol[1:][same]] = by_symbol[:-1][same]
    unknown = np.ones(n + 1, bool)
    unknown[[0, n]] = False
    left, right = np.array([0]), np.array([n])
    for _ in range(length):
        width = right - left
        at = np.repeat(left - np.concatenate([[0], np.cumsum(width)[:-1]]), width) + np.arange(width.sum())
        # of each interval and symbol, the first and the last row; intervals of one depth are disjoint, so both sort alike
        to = np.sort(lf[at[after[at] >= np.repeat(right, width)]]) + 1
        of = np.sort(lf[at[before[at] < np.repeat(left, width)]])
        new = unknown[to]
        left, right = of[new], to[new]
        unknown[right] = False
        if not len(left):
            break
    out = np.zeros(n, bool)
    pair = np.flatnonzero(unknown[1:n]) + 1
    out[order[pair]] = out[order[pair - 1]] = True
    return out


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of every run of True."""
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def _searched(size: int):
    """Repeated spans of the hulls of a shard."""

    def search(shard: pa.Table) -> pa.Table:
        shard = shard.combine_chunks()
        pieces = [np.frombuffer(x.as_buffer(), np.uint8) for x in shard.column("piece")]
        lengths = np.array([len(x) for x in pieces])
        begin = np.concatenate([[0], np.cumsum(lengths + 1)])
        symbols = np.full(begin[-1] + 1, 257, np.int16)  # between hulls; bytes are 1 .. 256
        for b, x in zip(begin, pieces, strict=False):
            symbols[b : b + len(x)] = x.astype(np.int16) + 1
        symbols[-1] = 0
        found = repeated_starts(symbols, size)
        rows, starts, ends = [], [], []
        for i, (b, n) in enumerate(zip(begin, lengths, strict=False)):
            first, last = _runs(found[b : b + n - size + 1])
            rows += [i] * len(first)
            starts.append(first)
            ends.append(last + size)
        take = pa.array(rows, pa.int64())
        at = shard.column("start").combine_chunks().take(take).to_numpy() if rows else np.zeros(0, np.int64)
        starts, ends = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, ends))
        return pa.table({"kd": shard.column("kd").take(take), "kh": shard.column("kh").take(take), "s": pa.array(at + starts), "e": pa.array(at + ends)})

    return search


def _windows(size: int):
    """Hash of every window of every hull."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at, n, buf, offsets in H.text_slices(batch.column(3)):
                count = np.diff(offsets) - size + 1
                row = np.repeat(np.arange(n), count)
                s = np.repeat(offsets[:-1] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                key = H.run_hash(H.prefix_sums(buf), s, s + size)
                take = pa.array(row + at)
                start = batch.column(2).take(take).to_numpy() + s - offsets[row]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(start), pa.array(key.view(np.int64))], ["kd", "kh", "s", "w"])

    return batches


def _cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge each row's spans and take them out of its bytes."""
    for batch in it:
        removed, spans, kept = [], [], []
        for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            text = text or b""
            merged: list[list[int]] = []
            for s, e in sorted((x["s"], x["e"]) for x in found or ()):
                if merged and s <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], e)
                else:
                    merged.append([s, e])
            parts, at = [], 0
            for s, e in merged:
                parts.append(text[at:s])
                at = e
            kept.append(b"".join([*parts, text[at:]]))
            removed.append(sum(e - s for s, e in merged))
            spans.append([{"s": s, "e": e} for s, e in merged])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t or b"") for t in batch.column(1).to_pylist()], pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "spans", "kept"])


def repeated_bytes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = 400, anchor_bytes: int = 100, group_bytes: int = 1 << 20, shard_bytes: int = 3 << 19) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, spans (array of s, e: removed runs), kept (binary: the other bytes).

    A byte is removed if a string of min_bytes bytes that covers it also starts anywhere else, in the same
    row or another; overlaps count, strings are judged on the input, matches never cross rows. Null texts are
    empty; texts under min_bytes keep every byte. Repeated rows repeat each other's bytes. A null id stays
    null. kept may begin or end within a character, as strings are bytes; text_of(kept) is the text that remains.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark, 250)  # whole texts go in and out
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # what tells rows apart: rows of one id and one text get one result
    base = base.withColumn("kd", F.coalesce("doc_id", F.lit(-1))).withColumn("kh", F.xxhash64("text"))
    anchors = written(base.select("kd", "kh", "text").mapInArrow(_anchored(min_bytes, anchor_bytes), "kd long, kh long, h long, hull long, start long, len long"), "anchors")
    often = anchors.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h")
    often = written(often, "often")  # as a table of its own: a join of two shuffles, which Spark splits where an anchor is hot
    twice = written(anchors.join(often, "h"), "repeated-anchors")
    hulls = written(twice.groupBy("h", "hull").agg(F.count("*").alias("c"), F.min(F.struct("kd", "kh", "start", "len")).alias("at")), "hulls")
    spans = twice.join(hulls.where("c > 1").select("h", "hull"), ["h", "hull"]).select("kd", "kh", F.col("start").alias("s"), (F.col("start") + F.col("len")).alias("e"))
    unlike = hulls.groupBy("h").agg(F.count("*").alias("d"), F.min("c").alias("least"), F.sum("at.len").alias("bytes")).where("d > 1 and least = 1").select("h", "bytes")
    asked = hulls.join(unlike, "h").select("at.kd", "at.kh", F.struct("h", "bytes", "at.start", "at.len").alias("x")).groupBy("kd", "kh").agg(F.collect_list("x").alias("x"))
    texts = base.select("kd", "kh", "text").join(asked, ["kd", "kh"])
    pieces = texts.select("kd", "kh", F.col("text").cast("binary").alias("text"), F.explode("x").alias("x")).select("kd", "kh", "x.h", "x.bytes", "x.start", F.expr("substring(text, cast(x.start as int) + 1, cast(x.len as int))").alias("piece"))
    pieces = written(pieces, "pieces")
    few = F.col("bytes") <= group_bytes
    total = pieces.where(few).agg(F.coalesce(F.sum(F.octet_length("piece")), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_bytes))
    shard = pieces.where(few).select("kd", "kh", "start", "piece", F.pmod(F.xxhash64("h"), F.lit(shards)).alias("shard"))
    spans = spans.unionByName(shard.groupBy("shard").applyInArrow(_searched(min_bytes), "kd long, kh long, s long, e long"))
    wide = pieces.where(~few).select("kd", "kh", "start", "piece").mapInArrow(_windows(min_bytes), "kd long, kh long, s long, w long")
    again = wide.groupBy("w").agg(F.count("*").alias("c")).where("c > 1").select("w")
    spans = spans.unionByName(wide.join(again, "w").select("kd", "kh", "s", (F.col("s") + min_bytes).alias("e")))
    by_doc = spans.groupBy("kd", "kh").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    held = base.join(by_doc, ["kd", "kh"], "left").select("doc_id", F.col("text").cast("binary").alias("text"), "spans")
    return held.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, spans array<struct<s:long,e:long>>, kept binary")


def text_of(kept: Column | str) -> Column:
    """The kept bytes as a text: each byte sequence that is no character any more is U+FFFD."""
    return F.make_valid_utf8(F.col(kept).cast("string") if isinstance(kept, str) else kept.cast("string"))
