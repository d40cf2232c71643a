"""Merkle manifest of a table: a digest for every row, a tree of digests for every group, a tree over
the groups' roots, and the proof of each row.

A level is a table (tree, idx, n, digest): node idx of the n nodes that the tree has on it. Every node
offers its digest to its siblings by an equijoin on the computed index (idx XOR 1 in binary trees,
else the slot moved by each offset inside the run); the nodes in slot 0 then hold their whole run and
emit its parent. A run at the end may be short, down to one node, which is hashed all the same. A tree
leaves with its root when one node is left. Each level is written to the shared folder, so a lost
executor costs one level at most, and no plan holds more than one self-join. Rows are spread by index:
a tree that holds a third of all rows is no larger task than others.

Proofs come down the same levels: a node's path is its own siblings and its parent's path. So a level's
shuffle carries half the rows of the one below it and one pair of digests less for each.

Leaves are numbered by a range sort over (tree, order); places inside a range partition follow from
the written row numbers, and the sizes of partitions, at most one row for each tree and partition, are
summed in front.

Null fields count as `-`, so a null and an empty text differ; a null tree sorts before all others;
null ids come first in their tree. Rows that agree in tree and order go by their digest; rows that
repeat whole are leaves of their own, next to each other. A table of one row has its leaf as root and
the empty proof; an empty table gives an empty manifest. Null ids are never tampered with.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .common import pick

FANOUT = 2
#: Rows whose crc32 of the id this number divides are tampered with in the query.
TAMPER = 7
#: Levels that one plan comes down before its paths are written.
JOINED = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sized(value: Column) -> Column:
    """A field of a leaf: UTF-8 byte count, `:`, value; `-` if null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[sized(v) for v in values]), 256))


def hexed(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def numbered(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """rows with idx, the place of a row in its group `by` in that order, from 0, and n, the size of
    the group. `by` has no nulls; equal rows come in any order."""
    keys = [by, *order, "_tie"]
    placed = stage(rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys)
                   .sortWithinPartitions(*keys).drop("_tie").withColumn("_at", F.monotonically_increasing_id()))
    piece = F.shiftright("_at", 33).alias("_piece")
    group = Window.partitionBy(by)
    starts = stage(placed.groupBy(by, piece).agg(F.min("_at").alias("_start"), F.count("*").alias("_m"))
                   .select(by, "_piece", "_start", (F.sum("_m").over(group.orderBy("_piece")) - F.col("_m")).alias("_front"),
                           F.sum("_m").over(group).alias("n")))
    return (placed.withColumn("_piece", piece).join(starts, [by, "_piece"])
            .withColumn("idx", F.col("_front") + F.col("_at") - F.col("_start"))
            .drop("_piece", "_at", "_start", "_front"))


def _meet(nodes: DataFrame, fanout: int) -> DataFrame:
    """nodes with left and right: the digests of the siblings in front and behind, one after another."""
    slot = F.col("idx") % fanout
    met = nodes
    for k in range(1, fanout):
        at = F.col("idx").bitwiseXOR(F.lit(1)) if fanout == 2 else F.col("idx") - slot + F.pmod(slot - k, F.lit(fanout))
        met = met.join(nodes.select("tree", at.alias("idx"), F.col("digest").alias(f"_{k}")), ["tree", "idx"], "left")
    none = F.lit(b"")

    def side(behind: bool) -> Column:
        return F.concat(none, *[F.when((slot + k < fanout) == F.lit(behind), F.coalesce(f"_{k}", none)).otherwise(none)
                                for k in range(1, fanout)])

    return met.withColumns({"left": side(False), "right": side(True)}).drop(*[f"_{k}" for k in range(1, fanout)])


def climb(nodes: DataFrame, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """(levels, roots) over leaves (tree, idx, n, digest, others): a level holds the nodes of the trees
    that are not done, with left and right; roots are (tree, digest)."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels, roots = [], [nodes.where("n = 1").select("tree", "digest")]
    while most > 1:
        met = stage(_meet(nodes.where("n > 1"), fanout))
        levels.append(met.drop("digest") if levels else met)
        nodes = met.where(F.col("idx") % fanout == 0).select(
            "tree", F.expr(f"idx div {fanout}").alias("idx"), F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n"),
            F.unhex(F.sha2(F.concat(hexed(F.col("digest")), hexed(F.col("right"))), 256)).alias("digest"))
        roots.append(nodes.where("n = 1").select("tree", "digest"))
        most = -(-most // fanout)
    return levels, reduce(DataFrame.unionByName, roots)


def paths(leaves: DataFrame, levels: list[DataFrame], fanout: int) -> DataFrame:
    """leaves (tree, n, digest, others; no idx) with path: the siblings (left, right) of each level, lowest first."""
    step = F.array(F.struct("left", "right"))
    above = None
    for depth in reversed(range(len(levels))):
        here = levels[depth]
        if above is None:
            made = here.withColumn("path", step)
        else:
            up = above.select("tree", F.col("idx").alias("_up"), F.col("path").alias("_path"))
            made = (here.withColumn("_up", F.expr(f"idx div {fanout}")).join(up, ["tree", "_up"], "left")
                    .withColumn("path", F.when(F.col("_path").isNull(), step).otherwise(F.concat(step, "_path"))).drop("_up", "_path"))
        made = made.drop("left", "right")
        above = made if depth % JOINED else stage(made) if depth else made
    alone = leaves.where("n = 1").drop("idx").withColumn("path", F.array().cast("array<struct<left:binary,right:binary>>"))
    return alone if above is None else alone.unionByName(above.drop("idx"))


def fold(leaf: Column, path: Column) -> Column:
    """The root (hex) that a leaf (hex) gives with the siblings of its path."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(hexed(s["left"]), h, hexed(s["right"])), 256))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(hexed(s["left"]), hexed(s["right"]))), ""), 256)


def manifest(leaves: DataFrame, order: list[str], fanout: int = FANOUT) -> DataFrame:
    """leaves (tree, not null; digest; others) with subroot, root and path, the proof from leaf to root.
    Trees are ordered by their key. No column may be called idx, n, subroot, root, path, left or right."""
    placed = stage(numbered(leaves, "tree", [*order, "digest"]))
    levels, roots = climb(placed, fanout)
    tops = stage(numbered(roots.select(F.lit(0).alias("_all"), F.col("tree").alias("name"), "digest"), "_all", ["name"])
                 .withColumnRenamed("_all", "tree"))
    upper, root = climb(tops, fanout)
    to_root = (paths(tops, upper, fanout).join(root.select("tree", F.col("digest").alias("root")), "tree")
               .select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), F.col("path").alias("_rest"), "root"))
    return (paths(placed, levels, fanout).join(stage(to_root), "tree")
            .withColumn("path", F.concat("path", "_rest")).drop("_rest", "n"))


def audit(docs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The manifest of docs (doc_id, source, lang, n_chars, text), a tree for each lang, and whether each
    row, some tampered with, still folds to the root."""
    d = pick(docs, *FIELDS)
    changed = (F.col("n_chars").cast("decimal(38,0)") + 1).cast("decimal(38,0)")
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER == 0
    leaves = d.select(
        F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("tree"), "doc_id", leaf_of(*[F.col(c) for c in FIELDS]).alias("digest"),
        F.when(touched, leaf_of(*[changed if c == "n_chars" else F.col(c) for c in FIELDS])).alias("tampered"))
    # digests are made once; the range sort reads its input twice
    made = manifest(stage(leaves), ["doc_id"], fanout)
    leaf, root = hexed(F.col("digest")), hexed(F.col("root"))
    folded = fold(F.coalesce(hexed(F.col("tampered")), leaf), F.col("path"))
    return (made.select("doc_id", leaf.alias("leaf"), hexed(F.col("subroot")).alias("subroot"), root.alias("root"),
                        proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))


_CRC = ("xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length({s}) + 1), lambda i: CAST(ord({s}[i]) AS BIGINT))), "
        "lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, k: xor(v >> 1, 3988292384 * (v & 1)))))")


def crc_sql(text: str) -> str:
    """crc32 of an ASCII string, in SQL."""
    return _CRC.replace("{s}", text)


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce('=' || lang, '') AS tree, {_leaf_sql('n_chars')} AS leaf,
    CASE WHEN doc_id IS NOT NULL AND {crc_sql("CAST(doc_id AS VARCHAR)")} % {TAMPER} = 0 THEN {_leaf_sql('(n_chars + 1)')} END AS tampered
  FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
up AS (
  SELECT tree, 0 AS lvl, idx, n, leaf AS h FROM placed
  UNION ALL
  SELECT tree, lvl + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM up WHERE n > 1 GROUP BY tree, lvl, idx // 2, n),
subs AS (SELECT tree, lvl AS height, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (
  SELECT 0 AS lvl, idx, n, subroot AS h FROM subs
  UNION ALL
  SELECT lvl + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM top WHERE n > 1 GROUP BY lvl, idx // 2, n),
ways AS (
  SELECT p.row, u.lvl AS lvl, (p.idx >> u.lvl) & 1 AS slot, s.h AS sibling
  FROM placed p JOIN up u ON u.tree = p.tree AND u.idx = p.idx >> u.lvl AND u.n > 1
  LEFT JOIN up s ON s.tree = p.tree AND s.lvl = u.lvl AND s.idx = xor(u.idx, 1)
  UNION ALL
  SELECT p.row, b.height + u.lvl, (b.idx >> u.lvl) & 1, s.h
  FROM placed p JOIN subs b ON b.tree = p.tree JOIN top u ON u.idx = b.idx >> u.lvl AND u.n > 1
  LEFT JOIN top s ON s.lvl = u.lvl AND s.idx = xor(u.idx, 1)),
proofs AS (SELECT row, string_agg(coalesce(sibling, ''), '' ORDER BY lvl) AS proof, count(*) AS len FROM ways GROUP BY row),
folds AS (
  SELECT row, 0 AS lvl, coalesce(tampered, leaf) AS h FROM placed
  UNION ALL
  SELECT f.row, f.lvl + 1, sha256(CASE WHEN w.slot = 1 THEN w.sibling ELSE '' END || f.h || CASE WHEN w.slot = 0 THEN coalesce(w.sibling, '') ELSE '' END)
  FROM folds f JOIN ways w ON w.row = f.row AND w.lvl = f.lvl)
SELECT p.doc_id, p.leaf, b.subroot, t.h AS root, sha256(coalesce(r.proof, '')) AS proof_sha256, f.h AS folded_root, f.h = t.h AS verified
FROM placed p JOIN subs b USING (tree) JOIN (SELECT h FROM top WHERE n = 1) t ON true LEFT JOIN proofs r ON r.row = p.row
JOIN folds f ON f.row = p.row AND f.lvl = coalesce(r.len, 0)
"""
