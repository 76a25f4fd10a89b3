"""Periodic runs of words: every maximal stretch that repeats its first words four times or more.

Runs come from Lyndon roots: a run's root, told by one of the two orders of words, is the longest Lyndon word at its
place; from there the period is extended to both sides by longest common extensions. Extensions to the right are
lowest common ancestors in the suffix tree of the text, those to the left in the tree of its reversal; the trees
are built by Ukkonen's algorithm, their ancestors found by range minima over the Euler tour.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from .hashing import SPACE, text_slices, words

RUNS = "array<struct<start bigint, length bigint, period bigint>>"
_FAR = 1 << 62


class Extensions:
    """Longest common extensions of the suffixes of a word sequence, in constant time each.

    ids: words as numbers from 1. `order` holds the places of the suffixes in sorted order, the empty one (at len(ids)) first.
    """

    #: Entries of the Euler tour in a block: minima of blocks have a sparse table, so that memory is linear.
    BLOCK = 16

    def __init__(self, ids: np.ndarray):
        self.n = len(ids)
        tour, self.first, self.order = _euler_tour(*_suffix_tree([*ids.tolist(), 0]))
        b = self.BLOCK
        padded = np.full(-(-len(tour) // b) * b, np.iinfo(np.int32).max, np.int32)
        padded[: len(tour)] = tour
        self.blocks = padded.reshape(-1, b)
        self.upto = np.minimum.accumulate(self.blocks, axis=1)
        self.since = np.minimum.accumulate(self.blocks[:, ::-1], axis=1)[:, ::-1]
        self.table = [self.upto[:, -1]]
        while 2 << (len(self.table) - 1) <= len(self.table[0]):
            x, half = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(x[:-half], x[half:]))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words are the same from i and from j on (i unlike j): the depth of their leaves' lowest common ancestor."""
        a, z = self.first[i], self.first[j]
        a, z = np.minimum(a, z), np.maximum(a, z)
        (ka, ra), (kz, rz) = np.divmod(a, self.BLOCK), np.divmod(z, self.BLOCK)
        out = np.minimum(self.since[ka, ra], self.upto[kz, rz])
        gap = kz - ka - 1
        apart = np.flatnonzero(gap > 0)
        level = np.frexp(gap[apart].astype(np.float64))[1] - 1
        for h in np.unique(level):
            x = apart[level == h]
            out[x] = np.minimum(out[x], np.minimum(self.table[h][ka[x] + 1], self.table[h][kz[x] - (1 << int(h))]))
        near = np.flatnonzero(gap < 0)
        if len(near):
            at = np.arange(self.BLOCK)
            inside = (at >= ra[near, None]) & (at <= rz[near, None])
            out[near] = np.where(inside, self.blocks[ka[near]], np.iinfo(np.int32).max).min(axis=1)
        return out.astype(np.int64)


def _suffix_tree(s: list[int]) -> tuple[dict[int, int], list[int], list[int], int, int]:
    """Ukkonen's suffix tree of s, whose last item is unlike all others: (child by node * width + first item, edge starts, edge ends, width, items).

    Node 0 is the root. A leaf's edge ends at len(s).
    """
    n = len(s)
    width = max(s) + 1
    child: dict[int, int] = {}
    start, end, link = [0], [0], [0]
    node = edge = length = waiting = 0  # the active point: `length` items down from node along the edge that begins with s[edge]
    for i, c in enumerate(s):
        waiting += 1
        last = -1  # the inner node made before, whose link is still open
        while waiting:
            if not length:
                edge = i
            key = node * width + s[edge]
            below = child.get(key)
            if below is None:
                child[key] = len(start)
                start.append(i)
                end.append(n)
                link.append(0)
                if last >= 0:
                    link[last] = node
                    last = -1
            else:
                at = start[below]
                span = (end[below] if end[below] < i else i) - at
                if length >= span:
                    edge += span
                    length -= span
                    node = below
                    continue
                if s[at + length] == c:
                    length += 1
                    if last >= 0:
                        link[last] = node
                    break
                middle = len(start)
                start += (at, i)
                end += (at + length, n)
                link += (0, 0)
                child[key] = middle
                child[middle * width + c] = middle + 1
                start[below] = at + length
                child[middle * width + s[at + length]] = below
                if last >= 0:
                    link[last] = middle
                last = middle
            waiting -= 1
            if node == 0:
                if length:
                    length -= 1
                    edge = i - waiting + 1
            else:
                node = link[node]
    return child, start, end, width, n


def _euler_tour(child: dict[int, int], start: list[int], end: list[int], width: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string depth of each node of the tour, a suffix's first entry in it, suffixes in sorted order)."""
    key = np.fromiter(child, np.int64, len(child))
    to = np.fromiter(child.values(), np.int64, len(child))
    by = np.argsort(key)
    to = to[by]
    begin = np.searchsorted(key[by] // width, np.arange(len(start) + 1)).tolist()
    to = to.tolist()
    tour, first, order = [0], [0] * n, []
    stack = [(0, begin[0], begin[1])]  # (depth, next child, end of children)
    while stack:
        depth, k, stop = stack.pop()
        if k == stop:
            if stack:
                tour.append(stack[-1][0])
            continue
        stack.append((depth, k + 1, stop))
        x = to[k]
        below = depth + end[x] - start[x]
        if end[x] == n:  # a leaf: its suffix is as long as its depth
            first[n - below] = len(tour)
            order.append(n - below)
            tour += (below, depth)
        else:
            tour.append(below)
            stack.append((below, begin[x], begin[x + 1]))
    return np.array(tour, np.int32), np.array(first, np.int64), np.array(order, np.int64)


def _lyndon_ends(rank: list[int]) -> tuple[list[int], list[int]]:
    """For each place, where the longest Lyndon word from there ends: the next place whose suffix is smaller, and by the other order the next that is greater (0: none)."""
    n = len(rank)
    smaller, greater = [n] * n, [0] * n
    for i in range(n - 1, -1, -1):
        j = i + 1
        while j < n and rank[j] > rank[i]:
            j = smaller[j]
        smaller[i] = j
        j = i + 1
        while j and (j == n or rank[j] < rank[i]):
            j = greater[j] if j < n else 0
        greater[i] = j
    return smaller, greater


def sequence_runs(ids: np.ndarray, least: int = 6, times: int = 4) -> np.ndarray:
    """Rows (start, length, period) of the runs of a word sequence: length >= max(least, times * period), by start, then period."""
    n = len(ids)
    ids = np.unique(ids, return_inverse=True)[1] + 1
    right = Extensions(ids)
    rank = np.empty(n + 1, np.int64)
    rank[right.order] = np.arange(n + 1)
    ends = np.array(_lyndon_ends(rank.tolist()[:n]), np.int64)
    i = np.tile(np.arange(n), 2)
    j = ends.reshape(-1)
    i, j = i[(j > 0) & (j < n)], j[(j > 0) & (j < n)]
    after = right(i, j)
    del right
    before = Extensions(ids[::-1])(n - i, n - j)
    found = np.stack([i - before, before + after + j - i, j - i], axis=1)
    found = found[found[:, 1] >= np.maximum(least, times * found[:, 2])]
    return np.unique(found, axis=0)[:, [0, 1, 2]] if len(found) else found


def candidate_stretches(row: np.ndarray, h: np.ndarray, bounds: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of disjoint stretches of words that hold every run whole, with a word more on each side where the row has one.

    In a run of period q each word past the first q stands at most q words after its last occurrence, and there are
    (times - 1) * q of them or more. For each scale 2**k >= q > 2**(k-1), stretches of words so near to their last
    occurrence, and as long as such a run needs, are taken with 2**k + 1 words before them. row: rows of the words; bounds: where rows begin.
    """
    n = len(h)
    by = np.lexsort((h, row))
    gap = np.full(n, _FAR, np.int64)
    same = (h[by][1:] == h[by][:-1]) & (row[by][1:] == row[by][:-1])
    gap[by[1:][same]] = by[1:][same] - by[:-1][same]
    longest = int(np.diff(bounds).max(initial=0))
    starts, ends = [], []
    k = 0
    while (q := (1 << k >> 1) + 1 if k else 1) * times <= longest:
        near = gap <= 1 << k
        edge = np.flatnonzero(np.diff(np.concatenate([[False], near, [False]]).view(np.int8)))
        s, e = edge[::2], edge[1::2]
        long = e - s >= max(least, times * q) - (1 << k if least > times * q else q)
        s, e = s[long], e[long]
        r = row[s]
        starts.append(np.maximum(s - (1 << k) - 1, bounds[r]))
        ends.append(np.minimum(e + 1, bounds[r + 1]))
        k += 1
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    s, e = np.concatenate(starts), np.concatenate(ends)
    by = np.argsort(s, kind="stable")
    s, e = s[by], np.maximum.accumulate(e[by])
    new = np.concatenate([[True], s[1:] >= e[:-1]]) if len(s) else np.zeros(0, bool)
    return s[new], e[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(e) - 1]])] if len(s) else e


def periodic_runs(text: Column, least: int = 6, times: int = 4) -> Column:
    """struct(n_words, runs, collapsed) of a text.

    Words are runs of anything but the six white-space characters of ASCII, with their case. runs: array<struct<start,
    length, period>> in words from 0, by start, then period: every stretch with smallest period `period` and length of
    max(least, times * period) or more that no neighbouring word extends. collapsed: the words that no run contains after
    its first `period` words, joined by one space. Null and empty texts have no words, no runs and an empty text.

    Only stretches that can hold a run have trees, told by the gaps between equal words; memory grows with the longest one,
    about 1 kB a word. Words are compared by hashes of 64 bits.
    """

    @arrow_udf(f"struct<n_words bigint, runs {RUNS}, collapsed string>")
    def run(texts: pa.Array) -> pa.Array:
        texts = texts.fill_null("")
        counts, at, found, collapsed = [], [], [], []
        for first, rows, buf, offsets in text_slices(texts):
            row, start, end, h = words(buf, offsets, lower=False)
            bounds = np.searchsorted(row, np.arange(rows + 1))
            here = [np.zeros((0, 3), np.int64)]
            for s, e in zip(*candidate_stretches(row, h, bounds, least, times)):
                x = sequence_runs(h[s:e], least, times)
                x[:, 0] += s
                here.append(x)
            here = np.concatenate(here)
            counts.append(np.diff(bounds))
            which = row[here[:, 0]] if len(here) else np.zeros(0, np.int64)
            at.append(np.bincount(which, minlength=rows))
            cover = np.zeros(len(h) + 1, np.int64)
            np.add.at(cover, here[:, 0] + here[:, 2], 1)
            np.add.at(cover, here[:, 0] + here[:, 1], -1)
            keep = (np.cumsum(cover[:-1]) == 0)
            here[:, 0] -= bounds[which]
            found.append(here)
            data, keep, b = buf.tobytes(), keep.tolist(), bounds.tolist()
            for r in range(rows):
                w = data[offsets[r] : offsets[r + 1]].split()
                collapsed.append(b" ".join(w if len(at[-1]) == 0 or not at[-1][r] else compress(w, keep[b[r] : b[r + 1]])))
        n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(at) if at else np.zeros(0, np.int64))])
        runs = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(3)], names=["start", "length", "period"]))
        return pa.StructArray.from_arrays([pa.array(n), runs, pa.array(collapsed, pa.binary()).cast(pa.string())], names=["n_words", "runs", "collapsed"])

    return run(text)


def longest_run(runs: Column) -> Column:
    """The run with the greatest exact length / period; of equals the first by start, then period; null for none."""
    better = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    return F.aggregate(F.slice(runs, 2, F.greatest(F.size(runs) - 1, F.lit(0))), F.get(runs, 0), lambda best, x: F.when(better(x, best), x).otherwise(best))


def runs_text(runs: Column) -> Column:
    """`start,length,period` and a line feed for each run."""
    return F.array_join(F.transform(runs, lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")


def with_planted_period(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where, of documents whose crc32(decimal doc_id) % 10 is 0, the words from word a on are those of a period: as the query's contract says. Null doc_id: unchanged."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    w = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")
    x = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, w).alias("w")).withColumn("n", F.size("w"))
    n, a = F.col("n"), F.try_mod("g", "n").cast("int")
    x = x.withColumn("a", a).withColumn("p", (F.lit(1) + F.floor((n - a) / (F.lit(3) + F.col("g") % 8))).cast("int"))
    rest = F.col("n") - F.col("a")
    again = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int")))
    moved = F.concat(F.slice("w", F.lit(1), F.col("a")), F.slice(again, F.lit(1), rest))
    return x.select("doc_id", F.when(F.col("n") > 0, F.array_join(moved, " ")).otherwise(F.col("text")).alias("text"))
