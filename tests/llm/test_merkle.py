"""The manifest against a tree built list by list."""
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tapeloom.llm import merkle
from . import brute

EXTRA = "idx int, n int, digest string, tree string, subroot string, root string, path string, left string, right string, _tie int, _at int"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes, k):
    """(root, for each node its siblings in front and behind, level by level)."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(proofs):
            base, slot = at[i] // k * k, at[i] % k
            run = nodes[base:base + k]
            p.append(("".join(run[:slot]), "".join(run[slot + 1:])))
        at = [i // k for i in at]
        nodes = [h(*nodes[i:i + k]) for i in range(0, len(nodes), k)]
    return nodes[0], proofs


def plain(rows, k=2):
    """Sorted result rows for rows (doc_id, text, lang, source, n_chars)."""
    by = defaultdict(list)
    for d, text, lang, source, n in rows:
        leaf = h(*map(field, (d, source, lang, n, text)))
        bad = d is not None and zlib.crc32(str(d).encode()) % 7 == 0
        by[lang].append((d, leaf, h(*map(field, (d, source, lang, None if n is None else n + 1, text))) if bad else leaf))
    groups = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for g in groups:
        by[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    made = {g: tree([r[1] for r in by[g]], k) for g in groups}
    if not groups:
        return []
    root, tops = tree([made[g][0] for g in groups], k)
    out = []
    for g, top in zip(groups, tops):
        for (d, leaf, used), low in zip(by[g], made[g][1]):
            folded = used
            for a, b in low + top:
                folded = h(a, folded, b)
            out.append((d, leaf, made[g][0], root, h(*[x for s in low + top for x in s]), folded, folded == root))
    return sorted(out, key=str)


def got(df):
    return sorted([(r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]) for r in df.collect()], key=str)


@pytest.mark.parametrize("fanout", (2, 5))
def test_awkward_rows(spark, fanout):
    rows = [(i, t, lang, s, n) for i, t, lang, s, n, *_ in brute.edge_rows()]
    rows += [(70, "x", "", "s", 1), (71, "x", "ü", "s", 1), (72, "x", "z", "", None), (73, None, "z", None, -5), (73, None, "z", None, -5), (None,) * 5,
             (-9, "minus", "z", "s", 2 ** 31 - 1)]
    df = spark.createDataFrame([(*r, *[None] * 11) for r in rows], f"doc_id bigint, text string, lang string, source string, n_chars int, {EXTRA}")
    assert got(merkle.audit(df, fanout)) == plain(rows, fanout)
    if fanout == 2:
        assert got(merkle.audit(df.where("doc_id = 71"))) == plain([r for r in rows if r[0] == 71])
    assert got(merkle.audit(df.where("false"), fanout)) == []


def test_uneven_trees(spark):
    """One tree with most rows, many small ones, a hot id, many partitions."""
    rows = [(i if i % 3 else 7, f"text {i % 50}", f"l{i}" if i < 40 else "hot", "s", i) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert got(merkle.audit(df.repartition(37))) == plain(rows)


def test_tampering_shows(spark):
    """A changed leaf breaks its own proof and no other."""
    df = spark.range(33).select(F.lit("t").alias("tree"), "id", merkle.leaf_of(F.col("id")).alias("digest"))
    made = merkle.manifest(df, ["id"]).withColumn("wrong", merkle.leaf_of(F.col("id") + 1))
    ok = made.select((merkle.fold(merkle.hexed(F.col("digest")), F.col("path")) == merkle.hexed(F.col("root"))).alias("a"),
                     (merkle.fold(merkle.hexed(F.col("wrong")), F.col("path")) == merkle.hexed(F.col("root"))).alias("b")).collect()
    assert [(r["a"], r["b"]) for r in ok] == [(True, False)] * 33
