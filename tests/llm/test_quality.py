"""Quality scores: plain sums and curves, held-out labels, awkward rows."""
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import quality, queries
from . import brute


def part_of(doc_id):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % 4


def test_statistics():
    get = lambda t: dict(zip(quality.STATISTICS, quality.statistics(t)))
    for t in (None, "", " \n\t ", "x" * 70_000, "a", "wörd " * 30_000, "\ud800", "| | |"):
        assert len(quality.statistics(t)) == len(quality.STATISTICS) and all(0 <= x <= 1 for x in quality.statistics(t)), t[:9]
    got = get("THE!! cat cat 12\n\nTHE!! cat cat 12")
    assert got["distinct"] == 3 / 8 and got["commonest"] == 0.5 and got["stutter"] == 2 / 8 and got["trigrams"] == 4 / 6
    assert got["upper_words"] == 2 / 8 and got["marked_words"] == 2 / 8 and got["letterless"] == 2 / 8
    assert got["repeated_lines"] == 0.5 and got["open_lines"] == 1 and got["digit"] == 4 / 34 and got["shout"] == 4 / 34
    long = "word. " * 50_000 + "END"
    assert get(long)["upper_words"] == 1 / 50_001  # whole texts


def test_isotonic_is_the_least_squares_curve():
    rng = np.random.default_rng(3)
    for _ in range(50):
        k = rng.integers(1, 9)
        n, at = rng.integers(1, 6, k).astype(float), np.sort(rng.choice(50, k, replace=False)).astype(float)
        ones = np.array([rng.integers(0, int(x) + 1) for x in n], float)
        x, y = quality.isotonic(at, n, ones)
        assert (np.diff(y) > 0).all() and (np.diff(x) > 0).all()
        # min-max formula of isotonic regression
        want = [max(min(ones[i:j + 1].sum() / n[i:j + 1].sum() for j in range(m, k)) for i in range(m + 1)) for m in range(k)]
        runs = [want.index(v) for v in sorted(set(want))]
        assert np.allclose(y, sorted(set(want))) and len(x) == len(runs)


def test_kernel_is_gaussian():
    rng = np.random.default_rng(4)
    k = len(quality.STATISTICS)
    f = quality.Features.over(np.full(k, 0.5), np.full(k, 0.1))
    a = 0.5 * quality.SCALE + rng.standard_normal((40, k)) * 0.1 * quality.SCALE
    z = f.of(a)[:, 1:] / quality.SCALE
    near = 2 / quality.FEATURES * z @ z.T
    x = a / quality.SCALE / 0.1
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * k * quality.WIDTH ** 2))
    assert np.abs(near - want).max() < 0.35 and np.abs(near - want).mean() < 0.06


def test_sums_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(5)
    k = len(quality.STATISTICS)
    rows = [([int(v) for v in rng.integers(0, quality.SCALE, k)], int(i % 3), int(i % 2)) for i in range(500)]
    df = spark.createDataFrame(rows, "stats array<int>, fold int, y int")
    f = quality.Features.over(np.full(k, 0.5), np.full(k, 0.2))
    made = quality.normal_equations(df.repartition(7), f)
    assert (made == quality.normal_equations(df.coalesce(1), f)).all()
    z = np.concatenate([f.of(np.array([r[0] for r in rows])), quality.SCALE * np.array([[r[2]] for r in rows])], axis=1)
    for fold in range(3):
        part = z[fold::3]
        assert (made[fold] == (part.T @ part).astype(np.int64)).all()


@pytest.mark.parametrize("sf", ("sf0.1",))
def test_held_out_labels(spark, sf):
    folder = f"/root/testdata/{sf}"
    got = {r["doc_id"]: r for r in queries.QUERIES["op13_quality"](spark, folder).collect()}
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    assert len(got) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r["held_out"] == (part_of(d) == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for d, r in got.items())
    held = [(got[r["doc_id"]], r["quality"]) for r in labels if part_of(r["doc_id"]) == 2]
    bad, good = [g["score"] for g, q in held if q == 0], [g["score"] for g, q in held if q == 1]
    assert len(bad) > 20 and np.mean([g["predicted"] == q for g, q in held]) > 0.98
    assert np.mean([a < b for a in bad for b in good]) > 0.98


def test_awkward_rows(spark):
    docs = brute.edge_docs(spark)
    ids = [r[0] for r in brute.edge_rows()]
    schema = "doc_id bigint, quality int, toxic int, stats string, label string, y int, fold int"
    labels = [(d, d % 2, None) for d in range(1, 13)] + [(5, None, 1), (None, 1, 1), (5, 1, 1), (5, 1, 1), (99, 0, 0)]
    labels = spark.createDataFrame([(*r, "s", "l", 1, 0) for r in labels], schema)
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    for used in (labels, labels.where("false"), labels.where("quality = 1")):
        got = quality.quality(docs, used, part).collect()
        assert sorted([r["doc_id"] for r in got], key=str) == sorted(ids, key=str) and all(0 <= r["score"] <= 1 for r in got)
        assert all(r["held_out"] == (part_of(r["doc_id"]) == 2) for r in got)
        if used is not labels:
            assert {r["score"] for r in got} == ({1.0} if used.count() else {0.5})
    same = {}
    for r in quality.quality(docs, labels, part).collect():
        same.setdefault(r["doc_id"], set()).add(r["score"])
    assert len(same[6]) == 1
    assert quality.quality(brute.no_docs(spark), labels, part).collect() == []
