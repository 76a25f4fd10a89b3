"""Near-duplicate documents: min-max hashing, banding, exact confirmation, components.

Min-max hashing keeps both the smallest and the largest value of a shingle set under each permutation, so
that half as many permutations are evaluated as the signature has entries. Bands of `rows` entries are taken
from the minima and from the maxima; documents that share a band are candidates, and every link is confirmed
on the full shingle sets.

Documents of equal sets are one node. Nodes that buckets hold together, directly or through others, are a
cluster. A cluster of a bounded size is settled in one task, which compares the full sets. A larger one is
dealt to blocks of a bounded size, and each block is settled so. Then the nodes are dealt anew, those of the
cluster's largest component apart from the others, and every two blocks that hold unlike components are compared
in a task of their own: full sets again, but for pairs that links connect already. So every two nodes of a
cluster are compared or connected, whatever buckets they share. Where much is linked, few blocks are left to
compare; where nothing is, pairs of blocks grow with the square of the cluster, and their memory is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import hashing as H
from .common import bounded_batches, connected, discard, written

U = np.uint64


def _unique_sorted(row: np.ndarray, h: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each row, sorted, and where each row's begin."""
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    row, h = row[new], h[new]
    return h, np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))]).astype(np.int64)


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = H.mix(np.arange(1, 2 * n + 1, dtype=U) * U(0x9E3779B97F4A7C15))
    return x[:n] | U(1), x[n:]


def _signed(k: int, bands: int, rows: int):
    perms = bands * rows // 2
    mul, add = _coefficients(perms)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids, texts = batch.column(0), batch.column(1).fill_null("")
            for at, n, buf, offsets in H.text_slices(texts):
                row, _, _, wh = H.words(buf, offsets)
                srow, sh = H.shingles(row, wh, n, k)
                h, begin = _unique_sorted(srow, sh, n)
                size = np.diff(begin)
                some = np.flatnonzero(size)
                key1, key2 = np.zeros(n, U), np.zeros(n, U)
                keys = np.zeros((n, bands), U)
                if len(some):
                    cut = begin[:-1][some]
                    key1[some] = np.add.reduceat(H.mix(h ^ U(0x1234567)), cut)
                    key2[some] = np.add.reduceat(H.mix(h ^ U(0x7654321987)), cut)
                    low, high = np.empty((perms, len(some)), U), np.empty((perms, len(some)), U)
                    for p in range(perms):
                        v = h * mul[p] + add[p]
                        v ^= v >> U(32)
                        low[p], high[p] = np.minimum.reduceat(v, cut), np.maximum.reduceat(v, cut)
                    for b in range(bands):
                        side, j = (low, b) if b < bands // 2 else (high, b - bands // 2)
                        x = np.full(len(some), b + 1, U)
                        for p in range(j * rows, (j + 1) * rows):
                            x = H.mix(x * U(0x2545F4914F6CDD1D) + side[p])
                        keys[some, b] = x
                flat = pa.array(keys[some].ravel().view(np.int64))
                ends = np.zeros(n + 1, np.int32)
                ends[1:] = np.cumsum(np.where(size > 0, bands, 0))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, n).cast(pa.int64()), pa.array(size, pa.int64()), pa.array(key1.view(np.int64)), pa.array(key2.view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), flat)],
                    ["doc_id", "n_shingles", "key1", "key2", "bands"],
                )

    return batches


def _sets(k: int):
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids, texts = batch.column(0), batch.column(1).fill_null("")
            for at, n, buf, offsets in H.text_slices(texts):
                row, _, _, wh = H.words(buf, offsets)
                h, begin = _unique_sorted(*H.shingles(row, wh, n, k), n)
                yield pa.RecordBatch.from_arrays([ids.slice(at, n).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(h.view(np.int64)))], ["node", "shingles"])

    return batches


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, bands: int = 32, rows: int = 4, cluster_nodes: int = 4096, cluster_shingles: int = 4_000_000) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Shingles are runs of k lower-cased (A-Z) words; a document of fewer words is one run; a document without
    words, or without text, has an empty set and is linked with nothing. Two documents are linked when
    100 * |intersection| >= percent * |union|. component_id is the smallest doc_id that links reach; kept is
    doc_id = component_id. With the defaults (32 bands of 4 entries from 64 permutations) a link of
    similarity 0.8 is missed with a probability of 5e-8.

    A cluster of up to cluster_nodes nodes and cluster_shingles shingles is settled in one task, a larger one in blocks.

    A row without doc_id is linked with nothing: component_id is null, kept is true. Rows that share a doc_id
    count as one document. Other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = written(base.mapInArrow(_signed(k, bands, rows), "doc_id long, n_shingles long, key1 long, key2 long, bands array<long>"), "signed")
    real = signed.where("n_shingles > 0 and doc_id is not null")
    classes = written(real.groupBy("key1", "key2").agg(F.min("doc_id").alias("node"), F.min("n_shingles").alias("n"), F.min("bands").alias("bands")), "classes")
    labels = _resolve(base, classes.select("node", "n", "bands"), k, percent, cluster_nodes, cluster_shingles)
    where = classes.select("key1", "key2", "node").join(labels, F.col("node") == F.col("id"), "left").select("key1", "key2", F.coalesce("label", "node").alias("found"))
    out = signed.select("doc_id", "n_shingles", "key1", "key2").join(where, ["key1", "key2"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("found")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _within(percent: int):
    """Components of one cluster, from the full sets of its nodes: rows (a: node, b: smallest node of its component, where it is another)."""

    def settle(cluster: pa.Table) -> pa.Table:
        cluster = cluster.combine_chunks()
        node = cluster.column("node").to_numpy()
        lists = cluster.column("shingles").chunk(0)
        m = len(node)
        start = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        values = lists.flatten().to_numpy()
        _, ids = np.unique(values, return_inverse=True)
        owner = np.repeat(np.arange(m), np.diff(start))
        order = np.argsort(ids, kind="stable")
        holders, first = owner[order], np.concatenate([[0], np.cumsum(np.bincount(ids))])
        size = np.diff(start)
        root = np.arange(m)

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for i in range(m - 1):
            mine = ids[start[i] : start[i + 1]]
            lo, n = first[mine], first[mine + 1] - first[mine]
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            common = np.bincount(holders[at], minlength=m)[i + 1 :].astype(np.int64)
            for j in np.flatnonzero(100 * common >= percent * (size[i] + size[i + 1 :] - common)) + i + 1:
                x, y = top(i), top(int(j))
                if x != y:
                    x, y = (x, y) if node[x] < node[y] else (y, x)
                    root[y] = x
        least = node[[top(i) for i in range(m)]]
        other = least != node
        return pa.table({"a": pa.array(node[other], pa.int64()), "b": pa.array(least[other], pa.int64())})

    return settle


def _across(percent: int):
    """Links between two blocks of a cluster that connect unlike components: rows (a, b)."""

    def settle(blocks: pa.Table) -> pa.Table:
        blocks = blocks.combine_chunks()
        right = blocks.column("right").to_numpy(zero_copy_only=False)
        node, label = blocks.column("node").to_numpy(), blocks.column("label").to_numpy()
        lists = blocks.column("shingles").chunk(0)
        start = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        _, ids = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        size = np.diff(start)
        kinds, root = np.unique(label, return_inverse=True)
        top = np.arange(len(kinds))  # the component of each label, kept flat
        mine, others = np.flatnonzero(~right), np.flatnonzero(right)
        held = np.repeat(right, size)
        owner = np.repeat(np.cumsum(right) - 1, size)[held]
        holders = owner[np.argsort(ids[held], kind="stable")]
        first = np.concatenate([[0], np.cumsum(np.bincount(ids[held], minlength=int(ids.max(initial=-1)) + 1))])
        other_size, of = size[others], root[others]
        a, b = [], []
        for i in mine.tolist():
            apart = top[of] != top[root[i]]
            if not apart.any():
                continue
            x = ids[start[i] : start[i + 1]]
            lo, n = first[x], first[x + 1] - first[x]
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            common = np.bincount(holders[at], minlength=len(others)).astype(np.int64)
            linked = np.flatnonzero((100 * common >= percent * (size[i] + other_size - common)) & apart)
            for j in linked.tolist():
                p, q = top[root[i]], top[of[j]]
                if p != q:
                    top[top == q] = p
                    a.append(node[i])
                    b.append(node[others[j]])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return settle


def _resolve(base: DataFrame, nodes: DataFrame, k: int, percent: int, cluster_nodes: int, cluster_shingles: int) -> DataFrame:
    """Labels (id, label) of the nodes that have links."""
    members = nodes.select("node", "n", F.explode("bands").alias("g"))
    busy = members.groupBy("g").agg(F.count("*").alias("c"), F.min("node").alias("first")).where("c > 1")
    groups = written(members.join(busy, "g").select("node", "n", "first"), "buckets")
    found = connected(groups.where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b")))
    sized = groups.select("node", "n").distinct()
    of = written(sized.join(found, sized.node == found.id).select("node", F.col("label").alias("cluster"), "n"), "clusters")
    texts = base.where("doc_id is not null").join(of, base.doc_id == of.node, "left_semi").dropDuplicates(["doc_id"])
    sets = written(texts.select("doc_id", "text").mapInArrow(_sets(k), "node long, shingles array<long>"), "sets")
    discard(groups)

    def dealt(df: DataFrame, *key: str) -> DataFrame:
        """df with the block of each node among those of its key: one block if they fit a task, else blocks of half that size."""
        sizes = df.groupBy(*key).agg(F.count("*").alias("nodes"), F.sum("n").alias("shingles"))
        share = F.greatest(F.col("nodes") / cluster_nodes, F.col("shingles") / cluster_shingles)
        sizes = sizes.select(*key, F.when(share <= 1, 1).otherwise(F.ceil(2 * share)).cast("long").alias("blocks"))
        return df.join(sizes, [*key]).withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))

    blocks = written(dealt(of, "cluster"), "blocks")
    settled = sets.join(blocks.select("node", "cluster", "block"), "node").groupBy("cluster", "block").applyInArrow(_within(percent), "a long, b long")
    links = written(settled, "links")
    large = blocks.where("blocks > 1").drop("blocks", "block")
    if large.isEmpty():
        found = connected(links)  # from a written table
        discard(sets)
        return found
    found = connected(links)
    large = written(large.join(found, large.node == found.id, "left").select("node", "cluster", "n", F.coalesce("label", "node").alias("label")), "large")
    widest = large.groupBy("cluster", "label").agg(F.count("*").alias("c")).groupBy("cluster").agg(F.max(F.struct("c", "label")).alias("m")).select("cluster", F.col("m.label").alias("widest"))
    part = dealt(large.join(widest, "cluster").withColumn("main", F.col("label") == F.col("widest")), "cluster", "main")
    part = written(part.select("node", "cluster", "label", "main", (2 * F.col("block") + F.col("main").cast("long")).alias("block")), "blocks")
    # blocks of the largest component don't meet each other, a block of others meets itself too
    each = written(part.select("cluster", "block", "main").distinct(), "pairs")
    pairs = each.join(each.select("cluster", F.col("block").alias("other"), F.col("main").alias("other_main")), "cluster")
    pairs = written(pairs.where("block <= other and not (main and other_main)").select("cluster", "block", "other"), "pairs")
    left = part.join(pairs, ["cluster", "block"]).select("node", "label", "cluster", "block", "other", F.lit(False).alias("right"))
    right = part.withColumnRenamed("block", "other").join(pairs, ["cluster", "other"]).select("node", "label", "cluster", "block", "other", F.lit(True).alias("right"))
    met = left.unionByName(right).join(sets, "node").groupBy("cluster", "block", "other").applyInArrow(_across(percent), "a long, b long")
    found = connected(links.unionByName(written(met, "links")))
    discard(sets)
    return found
