"""Best-fit packing of documents into sequences of several permitted lengths.

Items are dealt into blocks of about block_items by a hash of their id, so that any number of items packs in
tasks of a bounded size. In a block, longer items come first; each goes into the open bin that it leaves
fullest. If none has room, a bin is opened at the permitted length with the least cost for each token that it
is going to hold: the item, and the largest of the items still unpacked that fit in after it. At the end each bin is
downsized to the shortest permitted length that holds its contents.

A sequence costs its padded tokens, what attention among them costs (the square of the length over attention_tokens) and
what any sequence costs (overhead). So long sequences waste less on ends and overhead, short ones less on attention, and
which lengths to use together depends on the items. Every subset of the lengths that can hold the items is tried, and the
cheapest packing kept: the lengths are chosen together, by what they cost after downsizing.
"""

from __future__ import annotations

from heapq import heappop, heappush
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import bounded_batches, written

LENGTHS = (512, 1024, 2048, 4096)


#: Length at which attention costs as much as all else, and tokens that a sequence costs whatever its length.
ATTENTION_TOKENS, OVERHEAD = 8192.0, 32.0


def cost(length: int, attention_tokens: float = ATTENTION_TOKENS, overhead: float = OVERHEAD) -> float:
    """Cost of a sequence in tokens."""
    return length + length * length / attention_tokens + overhead


class _Room:
    """Open bins by free space: the fullest that still has room. Free spaces are below the largest length."""

    def __init__(self, most: int) -> None:
        self.size = 1
        while self.size < most + 1:
            self.size *= 2
        self.some = [False] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, free: int, bin_: int) -> None:
        heappush(self.bins[free], bin_)
        i = free + self.size
        while i and not self.some[i]:
            self.some[i] = True
            i //= 2

    def take(self, least: int) -> tuple[int, int] | None:
        """The bin with the least free space of at least `least`; of several the oldest."""
        i = least + self.size
        if not self.some[i]:
            while i > 1 and not (i % 2 == 0 and self.some[i + 1]):
                i //= 2
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.some[2 * i] else 2 * i + 1
        free = i - self.size
        bin_ = heappop(self.bins[free])
        if not self.bins[free]:
            self.some[i] = False
            i //= 2
            while i:
                self.some[i] = self.some[2 * i] or self.some[2 * i + 1]
                i //= 2
        return free, bin_


class _Rest:
    """Counts of the items still unpacked, by size."""

    def __init__(self, sizes: list[int], most: int) -> None:
        self.count = [0] * (most + 1)
        for n in sizes:
            self.count[n] += 1
        self.next = list(range(most + 1))  # from a size to the largest one not above it that is left, compressed as it is looked up

    def largest(self, most: int) -> int:
        """The largest size left of at most `most`; 0 for none."""
        at = most
        while at and not self.count[at]:
            at = self.next[at] - 1 if self.next[at] == at else self.next[at]
        x = most
        while x > at:
            x, self.next[x] = (self.next[x] - 1 if self.next[x] == x else self.next[x]), at
        return at

    def fill(self, free: int) -> int:
        """Tokens that the largest items left would put into free space, one size after another."""
        held, size = 0, free
        while (size := self.largest(min(size, free))):
            n = min(self.count[size], free // size)
            held, free = held + n * size, free - n * size
            size -= 1
        return held


def _tried(order: list[int], sizes: list[int], allowed: tuple[int, ...], lengths: tuple[int, ...], price: dict[int, float]) -> tuple[float, list[int], list[int]]:
    """(cost, bin of each item, length of each bin) of a packing that opens bins of the allowed lengths only."""
    room, rest, where, held = _Room(allowed[-1]), _Rest(sizes, lengths[-1]), [0] * len(sizes), []
    for i in order:
        n = sizes[i]
        rest.count[n] -= 1
        found = room.take(n)
        if found is None:
            length = min((c for c in allowed if c >= n), key=lambda c: (price[c] / (n + rest.fill(c - n)), -c))
            held.append(0)
            found = length, len(held) - 1
        free, b = found
        where[i] = b
        held[b] += n
        if free > n:
            room.add(free - n, b)
    fitted = [next(c for c in lengths if c >= h) for h in held]
    return sum(price[c] for c in fitted), where, fitted


def pack(sizes: list[int], lengths: tuple[int, ...], attention_tokens: float = ATTENTION_TOKENS, overhead: float = OVERHEAD) -> tuple[list[int], list[int]]:
    """(bin of each item, length of each bin) for items of 1 .. max(lengths) tokens. Of equally cheap packings that of the fewest lengths, shorter ones first, is kept."""
    if not sizes:
        return [], []
    lengths = tuple(sorted(set(lengths)))
    price = {n: cost(n, attention_tokens, overhead) for n in lengths}
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    longest = max(sizes)
    subsets = [x for k in range(1, len(lengths) + 1) for x in combinations(lengths, k) if x[-1] >= longest]
    _, where, fitted = min((_tried(order, sizes, x, lengths, price) for x in subsets), key=lambda t: t[0])
    return where, fitted


def _packed(lengths: tuple[int, ...], attention_tokens: float, overhead: float):
    def block(items: pa.Table) -> pa.Table:
        rows = sorted(zip(*(items.column(c).to_pylist() for c in ("uid", "piece", "n_tokens", "block")), strict=True))
        where, fitted = pack([r[2] for r in rows], lengths, attention_tokens, overhead)
        at = [0] * len(fitted)
        start = []
        for b, r in zip(where, rows, strict=True):
            start.append(at[b])
            at[b] += r[2]
        return pa.table({"uid": pa.array([r[0] for r in rows], pa.int64()), "piece": pa.array([r[1] for r in rows], pa.int64()), "bin": pa.array([f"{r[3]}-{b}" for b, r in zip(where, rows, strict=True)], pa.string()), "bin_length": pa.array([fitted[b] for b in where], pa.int64()), "bin_start": pa.array(start, pa.int64())})

    return block


def word_count(text: Column) -> Column:
    """Words of a text, as the stand-in for tokens where none are counted: without words, or text, 0."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def packed(docs: DataFrame, *, id_col: str = "doc_id", n_tokens: Column | None = None, text_col: str = "text", lengths: tuple[int, ...] = LENGTHS, attention_tokens: float = ATTENTION_TOKENS, overhead: float = OVERHEAD, block_items: int = 20_000) -> DataFrame:
    """Pieces of documents in bins: doc_id, piece, piece_start, n_tokens, bin_id, bin_length, bin_start.

    n_tokens counts a document's tokens (default: its words). A document over the longest length is cut into
    pieces of that length and a rest. A document without tokens, or without text, is one row with piece null
    and no bin. bin_id tells bins apart, bin_start is where in its bin a piece begins. Repeated rows are
    packed each; a null id stays null; an empty table gives an empty table. Of items of one length the first by row
    comes first. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    bounded_batches(spark, 10_000)
    most = max(lengths)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(n_tokens if n_tokens is not None else word_count(F.col(text_col)), F.lit(0)).cast("long").alias("tokens"))
    base = written(base.withColumn("uid", F.monotonically_increasing_id()), "lengths")
    cut = base.where("tokens > 0").select("doc_id", "uid", "tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(tokens - 1) div {most}"))).alias("piece"))
    pieces = cut.withColumn("n_tokens", F.least(F.lit(most), F.col("tokens") - F.col("piece") * most)).drop("tokens")
    blocks = max(1, -(-pieces.count() // block_items))
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("uid", "piece"), F.lit(blocks)))
    bins = dealt.select("uid", "piece", "n_tokens", "block").groupBy("block").applyInArrow(_packed(tuple(lengths), attention_tokens, overhead), "uid long, piece long, bin string, bin_length long, bin_start long")
    out = pieces.join(bins, ["uid", "piece"]).select("doc_id", "piece", (F.col("piece") * most).alias("piece_start"), "n_tokens", F.col("bin").alias("bin_id"), "bin_length", "bin_start")
    none = base.where("tokens <= 0").select("doc_id", F.lit(None).cast("long").alias("piece"), F.lit(0).cast("long").alias("piece_start"), F.lit(0).cast("long").alias("n_tokens"), F.lit(None).cast("string").alias("bin_id"), F.lit(None).cast("long").alias("bin_length"), F.lit(None).cast("long").alias("bin_start"))
    return out.unionByName(none)
