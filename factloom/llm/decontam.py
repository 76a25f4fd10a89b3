"""Benchmark decontamination: passages of documents within a small edit distance of benchmark items.

Symbols are words: runs of ASCII letters, digits and bytes beyond ASCII, with A-Z in lower case. A passage
matches an item of n words if their edit distance is at most floor((1 - similarity) * n).

1. Parts. An item of more than PART words is cut into parts of about that size. If a passage is within the edits of
   its item, one part is within its own share of them: floor((1 - similarity) * words of the part). So an item's
   recall is at least its parts', however long it is.
2. CGK random walk. Windows start at every word. A window, and each part, is read with a pointer that a random function
   of (step, symbol) moves on or holds, so that edit distance becomes Hamming distance. Walks from neighbouring starts
   that meet go on together, so a step costs less the later it is.
3. Bit-sampling LSH. Each repetition samples a few steps of a walk; a window and a part collide if all sampled symbols
   are equal. Walks are added until parts with the most edits allowed, edited at random, collide with the target
   recall (measured on the parts themselves); if it can't be reached, an error says so.
4. Exact verification. Parts that collided are aligned with the text there, and those within their edits lead to the
   alignment of the whole item with any part of the text around.

Documents are one pass without shuffle. The benchmark goes to the tasks in blocks of a bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import hashing as H
from .common import bounded_batches

U = np.uint64
OTHER = -1
#: Words of a part at most, and the samples of a repetition by the least number of words of a part.
PART = 14
SAMPLES = ((10, 3), (7, 3), (5, 3), (3, 3), (2, 2), (1, 1))
MATCHES = "array<struct<item_id:long,start_word:long,end_word:long,edits:long,item_words:long>>"


@dataclass
class Sampling:
    """One repetition for the parts of one size class: sampled steps, and the parts by their sampled symbols."""

    steps: list[int]
    listed: list[np.ndarray]  # symbols that parts have at each sampled step
    keys: np.ndarray  # sorted hashes of the sampled symbols
    part: np.ndarray


@dataclass
class Walk:
    multiplier: np.uint64  # bit `step` of a symbol's hash under it moves the pointer
    samplings: list[Sampling] = field(default_factory=list)


@dataclass
class Index:
    """A block of the benchmark, as the tasks use it."""

    item_id: list[int | None]
    words: list[np.ndarray]  # symbols of each item
    edits: list[int]  # allowed edits
    vocabulary: np.ndarray  # sorted word hashes; a symbol is an index of it
    item: np.ndarray  # of each part: its item, where it begins there, words, allowed edits, symbols (padded by -2)
    offset: np.ndarray
    size: np.ndarray
    share: np.ndarray
    symbols: np.ndarray
    walks: list[Walk]
    recall: float  # measured


def _moves(walk: Walk, h: np.ndarray) -> np.ndarray:
    return ((h * walk.multiplier) >> U(32)).astype(np.uint32)


def _steps(walk: Walk, h: np.ndarray, symbol: np.ndarray, last: int) -> tuple[list, list, list]:
    """Of every step up to the last: the symbols that walks from any start have reached, the first start of each, and the place of each at the next step.

    Walks never cross, so those that reach one position started from neighbouring words.
    """
    at = start = np.arange(len(h), dtype=np.int32)
    moves, symbols, starts, nexts = _moves(walk, h), [], [], []
    for step in range(last + 1):
        symbols.append(symbol[at])
        starts.append(start)
        moved = at + ((moves[at] >> np.uint32(step)) & np.uint32(1)).astype(np.int32)
        np.minimum(moved, len(h) - 1, out=moved)
        new = np.ones(len(moved), bool)
        new[1:] = moved[1:] != moved[:-1]
        nexts.append(np.cumsum(new, dtype=np.int32) - 1)
        at, start = moved[new], start[new]
    return symbols, starts, nexts


def _key(key: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    return H.mix(key * U(0x2545F4914F6CDD1D) + symbol.astype(np.int64).view(U))


def _collisions(walks: list[Walk], h: np.ndarray, symbol: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first start, last start, part) of windows and parts that collide; h: word hashes, symbol: their index in the vocabulary or -1."""
    found, symbol = [], symbol.astype(np.int32)
    for walk in walks:
        symbols, starts, nexts = _steps(walk, h, symbol, max(x.steps[-1] for x in walk.samplings))
        for x in walk.samplings:
            now = some = key = None
            for to, of in zip(x.steps, x.listed, strict=True):
                listed = np.zeros(vocabulary + 1, bool)  # the last one: words out of the vocabulary
                listed[of] = True
                if now is None:
                    s = symbols[to]
                    some = now = np.flatnonzero(listed[s])
                    key = _key(np.zeros(len(now), U), s[now])
                else:
                    for step in range(step, to):
                        now = nexts[step][now]
                    s = symbols[to][now]
                    known = np.flatnonzero(listed[s])
                    some, now, key = some[known], now[known], _key(key[known], s[known])
                step = to
            lo = np.searchsorted(x.keys, key)
            count = np.searchsorted(x.keys, key, "right") - lo
            which = np.repeat(np.arange(len(some)), count)
            if len(which):
                nth = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
                start = starts[x.steps[0]]
                end = np.append(start[1:], len(h)) - 1
                found.append((start[some][which], end[some][which], x.part[lo[which] + nth]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True))


def _words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(row, word hash) of a list of texts."""
    data = [(t or "").encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
    row, _, _, h = H.words(np.frombuffer(b"".join(data), np.uint8), offsets, space=H.PUNCTUATION)
    return row, h


def _edited(item: np.ndarray, k: int, rng: np.random.Generator) -> list[int]:
    """An item after k random edits."""
    x = list(item)
    for _ in range(k):
        at = int(rng.integers(0, len(x)))
        what = rng.integers(0, 3)
        if what == 0:
            x[at] = OTHER
        elif what == 1:
            x.insert(at, OTHER)
        elif len(x) > 1:
            del x[at]
    return x


def _with_samplings(walk: Walk, classes: list[tuple[tuple[int, int], np.ndarray]], size: np.ndarray, symbols: np.ndarray, hashes: np.ndarray, samplings: int, rng: np.random.Generator) -> Walk:
    """The walk with its repetitions for each size class. A part is left out of a repetition whose samples aren't of several of its words."""
    moves = _moves(walk, hashes)
    for (least, samples), members in classes:
        reach = max(samples, least + least // 2)
        # where each part's own walk stands
        pointer, own, place = np.zeros(len(members), np.int64), np.full((len(members), reach), -2, np.int64), np.zeros((len(members), reach), np.int64)
        for step in range(reach):
            inside = pointer < size[members]
            s = np.where(inside, symbols[members, np.minimum(pointer, size[members] - 1)], -2)
            own[:, step], place[:, step] = s, pointer
            pointer += np.where(inside, (moves[np.maximum(s, 0)] >> np.uint32(step)) & np.uint32(1), 0)
        seen = set()
        for _ in range(samplings if least > 4 else 1):
            steps = sorted(rng.choice(reach, samples, replace=False).tolist())
            if tuple(steps) in seen:
                continue
            seen.add(tuple(steps))
            whole = (own[:, steps] >= 0).all(1) & (np.diff(place[:, steps], axis=1) > 0).all(1)
            key = np.zeros(int(whole.sum()), U)
            for step in steps:
                key = _key(key, own[whole, step])
            order = np.argsort(key, kind="stable")
            walk.samplings.append(Sampling(steps, [np.unique(own[whole, step]) for step in steps], key[order], members[whole][order]))
    return walk


def index(items: list[tuple[int | None, str | None]], similarity: float, recall: float, samplings: int = 8, most_walks: int = 64, seed: int = 7) -> Index | None:
    """Index a block of items; None if none of them has a word."""
    row, h = _words([t for _, t in items])
    vocabulary = np.unique(h)
    symbol = np.searchsorted(vocabulary, h).astype(np.int64)
    some = np.unique(row)
    if not len(some):
        return None
    words = [symbol[row == r] for r in some]
    allowed = lambda n: int((1 - similarity) * n + 1e-9)
    parts = []
    for i, w in enumerate(words):
        cuts = np.linspace(0, len(w), -(-len(w) // PART) + 1).astype(int)
        parts += [(i, int(a), w[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    size = np.array([len(p) for _, _, p in parts])
    share = np.array([allowed(n) for n in size])
    symbols = np.full((len(parts), PART), -2, np.int64)
    for j, (_, _, p) in enumerate(parts):
        symbols[j, : len(p)] = p
    classes, above = [], PART + 1
    for least, samples in SAMPLES:
        members = np.flatnonzero((size >= least) & (size < above))
        above = least
        if len(members):
            classes.append(((least, samples), members))
    rng = np.random.default_rng(seed)
    # trial texts: parts with as many random edits as are allowed, several of each where parts are few, other words between
    pick = np.resize(rng.permutation(len(parts)), max(600, min(len(parts), 3000)))
    texts = [[*_edited(parts[j][2], int(share[j]), rng), *[OTHER] * PART] for j in pick]
    trial, owner = np.concatenate(texts), np.repeat(np.arange(len(texts)), [len(x) for x in texts])
    trial_hash = np.where(trial >= 0, vocabulary[np.maximum(trial, 0)], H.mix(np.arange(len(trial), dtype=U) + U(1)))
    found = np.zeros(len(pick), bool)
    walks: list[Walk] = []
    while found.mean() < recall:
        if len(walks) == most_walks:
            raise RuntimeError(f"{most_walks} walks find {found.mean():.3f} of the trial windows, not {recall}")
        walk = Walk(H.mix(rng.integers(0, 1 << 62, 1).astype(U))[0] | U(1))
        walks.append(_with_samplings(walk, classes, size, symbols, vocabulary, samplings, rng))
        start, _, part = _collisions(walks[-1:], trial_hash, trial, len(vocabulary))
        hit = pick[owner[start]] == part
        found[owner[start[hit]]] = True
    return Index([items[r][0] for r in some], words, [allowed(len(w)) for w in words], vocabulary, np.array([i for i, _, _ in parts]), np.array([a for _, a, _ in parts]), size, share, symbols, walks, float(found.mean()))


def _least_edits(ix: Index, part: np.ndarray, text: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least edit distance of each part to any part of text[lo : hi], where the first such part ends), all at once (bit-parallel)."""
    size = ix.size[part].astype(np.int64)
    full, top = (1 << size) - 1, 1 << (size - 1)
    own, bit = ix.symbols[part], 1 << np.arange(PART, dtype=np.int64)
    up, down, now = full.copy(), np.zeros(len(part), np.int64), size.copy()
    best, end = now.copy(), lo.copy()
    for j in range(int((hi - lo).max()) if len(part) else 0):
        x = text[np.minimum(lo + j, len(text) - 1)]
        eq = ((own == x[:, None]) * bit).sum(1)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph, mh = down | (full & ~(xh | up)), up & xh
        now = now + ((ph & top) != 0) - ((mh & top) != 0)
        ph, mh = (ph << 1) & full, (mh << 1) & full  # a part may begin anywhere at no cost
        up, down = mh | (full & ~(xv | ph)), ph & xv
        less = (now < best) & (lo + j < hi)
        best, end = np.where(less, now, best), np.where(less, lo + j + 1, end)
    return best, end


def fit(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(least edit distance of the item to any part of text, where the first such part ends)."""
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    masks: dict[int, int] = {}
    for i, x in enumerate(item.tolist()):
        masks[x] = masks.get(x, 0) | 1 << i
    up, down, now = full, 0, m
    best, end = m, 0
    for j, x in enumerate(text.tolist(), 1):
        eq = masks.get(x, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph, mh = down | (full & ~(xh | up)), up & xh
        if ph & top:
            now += 1
        elif mh & top:
            now -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full  # a part may begin anywhere at no cost
        up, down = mh | (full & ~(xv | ph)), ph & xv
        if now < best:
            best, end = now, j
    return best, end


def _found(ix: Index, row: np.ndarray, h: np.ndarray, n: int) -> dict[int, list[dict]]:
    """Matches of every row of a slice."""
    out: dict[int, list[dict]] = {}
    if not len(h):
        return out
    at = np.minimum(np.searchsorted(ix.vocabulary, h), len(ix.vocabulary) - 1)
    symbol = np.where(ix.vocabulary[at] == h, at, OTHER).astype(np.int64)
    begin = np.searchsorted(row, np.arange(n))
    end = np.searchsorted(row, np.arange(n), "right")
    first, last, part = _collisions(ix.walks, h, symbol, len(ix.vocabulary))
    near = []
    for a in range(0, len(part), 100_000):
        f, t, p = first[a : a + 100_000], last[a : a + 100_000], part[a : a + 100_000]
        r, k = row[f], ix.share[p]
        # starts of one collision that stand in another row are that row's own windows too
        for r in (r, row[t]) if (row[f] != row[t]).any() else (r,):
            lo, hi = np.maximum(f - k, begin[r]), np.minimum(t + ix.size[p] + k, end[r])
            edits, to = _least_edits(ix, p, symbol, lo, hi)
            fits = edits <= k
            near.append(np.stack([r[fits], ix.item[p[fits]], (to - ix.size[p] - ix.offset[p])[fits]]))
    if not near:
        return out
    r, item, start = np.unique(np.concatenate(near, axis=1), axis=1)  # sorted by row, item and where the item would begin
    if not len(r):
        return out
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (item[1:] != item[:-1]) | (start[1:] - start[:-1] > 2 * np.array(ix.edits)[item[1:]] + 1)
    groups = np.flatnonzero(new)
    best: dict[tuple[int, int], dict] = {}
    for x, y in zip(groups, np.append(groups[1:], len(r)), strict=True):
        i, doc = int(item[x]), int(r[x])
        k, w, base = ix.edits[i], ix.words[i], int(begin[doc])
        a, b = max(base, int(start[x]) - 2 * k), min(int(end[doc]), int(start[y - 1]) + len(w) + 2 * k)
        edits, to = fit(w, symbol[a:b])
        if edits > k:
            continue
        back, length = fit(w[::-1], symbol[a : a + to][::-1])
        length = length if back == edits else to
        m = {"item_id": ix.item_id[i], "start_word": a + to - length - base, "end_word": a + to - base, "edits": edits, "item_words": len(w)}
        old = best.get((doc, i))
        if old is None or (m["edits"], m["start_word"]) < (old["edits"], old["start_word"]):
            best[doc, i] = m
    for (x, _), m in sorted(best.items()):
        out.setdefault(x, []).append(m)
    return out


def _scan(shared, text_col: str):
    kind = pa.list_(pa.struct([(k, pa.int64()) for k in ("item_id", "start_word", "end_word", "edits", "item_words")]))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix: Index = shared.value
        for batch in it:
            texts = batch.column(0).field(text_col)
            for at, n, buf, offsets in H.text_slices(texts.fill_null("")):
                row, _, _, h = H.words(buf, offsets, space=H.PUNCTUATION)
                found = _found(ix, row, h, n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array([found.get(i, []) for i in range(n)], kind)], ["row", "matches"])

    return batches


def scan(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similarity: float = 0.8, recall: float = 0.9, block_bytes: int = 2 << 20) -> DataFrame:
    """Every row of docs as a struct `row`, with `matches`: the items that it holds (MATCHES), best passage each.

    Null and empty texts match nothing, nor do items without a word; items of under five words match only
    unchanged. Repeated items are reported each, repeated rows too; of equally good passages the first is told. An empty
    table of either kind gives no matches. recall is that of parts with the most edits allowed; a whole item has several
    parts, or fewer edits, and is found more often. The benchmark is read in blocks of about block_bytes of text, one
    pass over docs each. Columns of docs can't clash, as they stand in `row`.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    out = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    schema = T.StructType([out.schema["row"], T.StructField("matches", T._parse_datatype_string(MATCHES))])
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).where("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    done = None
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        ix = index([tuple(r) for r in rows], similarity, recall)
        if ix is None:
            continue
        shared = spark.sparkContext.broadcast(ix)
        if done is None:
            done = out.mapInArrow(_scan(shared, text_col), schema)
        else:
            more = done.withColumnRenamed("matches", "before").select(F.struct(F.struct(F.col(f"row.`{text_col}`").alias(text_col), "row", "before").alias("x")).alias("y"))
            wrapped = T.StructType([T.StructField("row", more.schema["y"].dataType["x"].dataType), schema["matches"]])
            done = more.select(F.col("y.x").alias("row")).mapInArrow(_scan(shared, text_col), wrapped).select(F.col("row.row").alias("row"), F.concat("row.before", "matches").alias("matches"))
    return done if done is not None else out.withColumn("matches", F.array().cast(MATCHES))


def contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per document and item that it holds: doc_id, item_id, start_word, end_word, edits, item_words."""
    found = scan(docs, benchmark, **options)
    return found.select(F.col(f"row.`{id_col}`").alias("doc_id"), F.explode("matches").alias("m")).select("doc_id", "m.*")
