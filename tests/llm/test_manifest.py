"""The manifest against a tree built by hand."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from factloom.llm import manifest
from factloom.llm.queries import op13_merkle_manifest


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(digests):
    """(root, siblings of each level for each leaf as (left, right))."""
    paths, at, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        runs = [level[i : i + 16] for i in range(0, len(level), 16)]
        for k, a in enumerate(at):
            run, d = runs[a // 16], a % 16
            paths[k].append((run[:d], run[d + 1 :]))
        at, level = [a // 16 for a in at], [sha("".join(r)) for r in runs]
    return level[0], paths


def by_hand(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    done = {}
    for s in names:
        members = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        done[s] = (members, *tree([leaf(r) for r in members]))
    root, tops = tree([done[s][1] for s in names]) if names else (None, [])
    out = []
    for s, top in zip(names, tops):
        members, subroot, paths = done[s]
        for r, path in zip(members, paths):
            path = path + top
            fold = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                fold = leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            for left, right in path:
                fold = sha("".join(left) + fold + "".join(right))
            out.append((r[0], leaf(r), subroot, root, sha("".join("".join(a + b) for a, b in path)), fold, fold == root))
    return sorted(out, key=repr)


def documents(spark, rows, at):
    # columns of the names that the operator uses inside
    spark.createDataFrame([(*r, 1, "p", "g") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, idx long, part string, grp string").write.parquet(f"{at}/documents.parquet")


def made(seed, sizes):
    rng, rows, i = random.Random(seed), [], 0
    for s, n in sizes.items():
        for _ in range(n):
            text = rng.choice([None, "", "plain", "Ends In Capitals", "É é :1-", f"Text {rng.randint(0, 9)}"])
            rows.append((i, s, rng.choice(["en", None]), None if text is None else len(text), text))
            i += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("sizes", [
    {"a": 1}, {"a": 16}, {"a": 17, "b": 1}, {"a": 257, None: 3, "": 2, "é": 33, "Z": 1, "z": 16},
    {f"s{k}": 1 + k % 3 for k in range(40)}, {None: 1}, {"hot": 700, **{f"s{k}": 1 for k in range(20)}},
])
def test_the_query_against_a_tree_by_hand(spark, tmp_path, sizes):
    rows = made(len(sizes), sizes)
    documents(spark, rows, tmp_path)
    found = op13_merkle_manifest(spark, str(tmp_path)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted(map(tuple, found), key=repr) == by_hand(rows)


def test_nulls_repeated_rows_and_repeated_ids(spark, tmp_path):
    rows = made(3, {"a": 30, None: 20})
    rows += rows[:20] + [(None, "a", None, None, None)] * 40 + [(None, None, None, None, None)] * 3 + [(rows[0][0], rows[0][1], "xx", 1, "Other")] * 2 + [(0, "long", "en", 1, "Long " * 100_000)]
    documents(spark, rows, tmp_path)
    found = op13_merkle_manifest(spark, str(tmp_path)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted(map(tuple, found), key=repr) == by_hand(rows)


def test_empty_table(spark, tmp_path):
    documents(spark, [], tmp_path)
    assert op13_merkle_manifest(spark, str(tmp_path)).collect() == []


def test_places_are_those_of_the_order_however_rows_are_dealt(spark):
    rows = [("g" if i % 3 else "h", i * 7919 % 1000) for i in range(1000)]
    df = spark.createDataFrame(rows, "g string, o long").repartition(7)
    found = sorted(map(tuple, manifest.ranked(df, ["g"], ["o"], "ranked").select("g", "o", "idx", "n").collect()))
    wanted = []
    for g in ("g", "h"):
        mine = sorted(o for x, o in rows if x == g)
        wanted += [(g, o, k, len(mine)) for k, o in enumerate(mine)]
    assert found == sorted(wanted)


def test_fields_can_not_run_into_each_other(spark):
    df = spark.createDataFrame([("a", "b"), ("a1:b", None), ("", "ab"), (None, "ab"), ("-", None), (None, "-")], "x string, y string")
    assert df.select(manifest.leaf_digest([F.col("x"), F.col("y")]).alias("d")).distinct().count() == 6
