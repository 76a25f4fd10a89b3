"""Periodic runs against all periods at all places."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm.helpers import corpus, empty, frame

from factloom.llm import periodic
from factloom.llm.queries import op11_periodic_runs


def all_runs(w, least=6, times=4):
    found = set()
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            if w[i] == w[i + q]:
                j = i
                while j + q < len(w) and w[j] == w[j + q]:
                    j += 1
                if j - i + q >= max(least, times * q):
                    found.add((i, j - i + q, q))
                i = j
            i += 1
    return sorted((s, n, q) for s, n, q in found if not any(all(w[k] == w[k + d] for k in range(s, s + n - d)) for d in range(1, q)))


def split(text):
    return (text or "").encode().split()


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return b" ".join(x for i, x in enumerate(w) if i not in gone).decode()


def periodic_words(rng, n, letters):
    w = [rng.randint(1, letters) for _ in range(n)]
    for _ in range(rng.randint(0, 2)):
        a, p = rng.randrange(n), rng.randint(1, 9)
        for i in range(a + p, min(n, a + rng.randint(1, 8) * p)):
            w[i] = w[i - p]
    return w


@pytest.mark.parametrize(("least", "times"), [(6, 4), (2, 2), (9, 3)])
def test_runs_of_sequences_and_the_stretches_that_hold_them(least, times):
    rng = random.Random(least)
    for _ in range(600):
        w = periodic_words(rng, rng.randint(1, 90), rng.randint(1, 5))
        wanted = all_runs(w, least, times)
        assert [tuple(r) for r in periodic.sequence_runs(np.array(w), least, times).tolist()] == wanted
        found = []
        h = np.array(w, np.uint64)
        for s, e in zip(*periodic.candidate_stretches(np.zeros(len(w), np.int64), h, np.array([0, len(w)]), least, times)):
            x = periodic.sequence_runs(h[s:e], least, times)
            x[:, 0] += s
            found += [tuple(r) for r in x.tolist()]
        assert found == wanted


def test_extensions_are_common_prefixes():
    rng = random.Random(3)
    for n in (1, 2, 17, 300):
        w = np.array([rng.randint(1, 2) for _ in range(n)])
        x = periodic.Extensions(w)
        i, j = map(np.array, zip(*[(a, b) for a in range(n + 1) for b in range(n + 1) if a != b]))
        wanted = [next((k for k in range(n) if max(a, b) + k >= n or w[a + k] != w[b + k]), n) for a, b in zip(i.tolist(), j.tolist())]
        assert x(i, j).tolist() == wanted
        assert x.order.tolist() == sorted(range(n + 1), key=lambda k: w[k:].tolist())


def test_documents_with_nulls_repeats_white_space_and_long_texts(spark):
    rows = corpus()
    rng = random.Random(9)
    rows += [(9100 + k, " ".join(f"w{x}" for x in periodic_words(rng, 80, 3))) for k in range(40)]
    rows += [(9200, "a\x0ba a\ta a\r\na"), (9201, "A a A a A a A a"), (9202, "same " * 30000), (9203, " ".join(f"p{i % 700}" for i in range(9000))), (9204, "x y " * 7), (9205, "x\x1cy")]
    found = frame(spark, rows).select("doc_id", periodic.periodic_runs(F.col("text")).alias("x")).select("doc_id", "x.*").collect()
    assert len(found) == len(rows)
    for r, (i, t) in zip(sorted(found, key=lambda r: (r.doc_id is None, r.doc_id, r.collapsed)), sorted(rows, key=lambda r: (r[0] is None, r[0], collapsed(split(r[1]), [])))):
        w = split(t)
        assert r.doc_id == i and r.n_words == len(w)
        if len(w) < 3000:
            runs = all_runs(w)
        else:
            runs = {9202: [(0, 30000, 1)], 9203: [(0, 9000, 700)]}.get(i, [])
        assert [tuple(x) for x in r.runs] == runs and r.collapsed == collapsed(w, runs)


def test_longest_run_is_compared_exactly_and_ties_go_to_the_first(spark):
    rows = [([(3, 12, 3), (20, 8, 2), (40, 41, 10)],), ([(0, 41, 10), (50, 82, 20), (90, 9, 2)],), ([],), ([(1, 10, 2), (1, 10, 2)],)]
    df = spark.createDataFrame(rows, f"runs {periodic.RUNS}")
    found = [r.x and tuple(r.x) for r in df.select(periodic.longest_run(F.col("runs")).alias("x")).collect()]
    assert found == [(40, 41, 10), (90, 9, 2), None, (1, 10, 2)]


def test_the_query_against_brute_force(spark, tmp_path):
    rows = [*corpus(seed=4), (30, None), (40, ""), *((500 + k, " ".join(f"w{x}" for x in periodic_words(random.Random(k), 50, 3))) for k in range(60))]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    wanted = []
    for i, t in rows:
        w = split(t)
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = all_runs(w)
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if runs else (None,) * 3
        text = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        wanted.append((i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(collapsed(w, runs).encode()).hexdigest()))
    found = op11_periodic_runs(spark, str(tmp_path)).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, wanted))
    assert sum(r[1] > 0 for r in wanted) > 20


def test_empty_table(spark):
    assert empty(spark).select(periodic.periodic_runs(F.col("text"))).collect() == []
