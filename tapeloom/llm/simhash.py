"""SimHash near-duplicates by pigeonring filtering.

A fingerprint is cut into a ring of five segments. If two fingerprints differ in at most two bits,
there is a segment from which every chain of l consecutive segments holds at most 2 l / 5 of the
differing bits. For l = 1 and 2 the budget is below one bit, so the first two segments of the chain
are equal and serve as join key; the budgets of the longer chains prune candidates before the full
Hamming check. Equal fingerprints are one class, and links are searched between classes only.

A key that more than CROWD classes share is not paired out. Its classes are linked exactly through
single-bit neighbours: two fingerprints at most two bits apart have a common one. A neighbour has at
most 65 classes around it, all of them linked, so a chain through them keeps every link's component.

Null text counts as empty; without words a fingerprint is zero and is linked like any other.
Repeated rows and ids are kept as they are; null ids are kept and never name a component unless a
component has no other. An empty table gives an empty result.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import known_size, stage
from .common import arrow_map, components, pick, strings

WORDS, BITS_APART, CROWD = 3, 2, 64
SEGMENTS = (13, 13, 13, 13, 12)


def fingerprint(text: str, k: int = WORDS) -> int:
    """64-bit SimHash of the k-word shingles; case of A-Z and ASCII white space do not count."""
    from xxhash import xxh64_intdigest as h

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) <= k:
        hashes = [h(flat, 42)]
    else:
        length = np.fromiter(map(len, words), np.int64, len(words)) + 1
        starts = np.concatenate([[0], np.cumsum(length)[:-1]])
        ends = (starts + length - 1)[k - 1:].tolist()
        hashes = [h(flat[a:b], 42) for a, b in zip(starts.tolist(), ends)]
    total = np.zeros(64, np.int64)
    values = np.array(hashes, ">u8")
    for i in range(0, len(values), 1 << 16):
        part = values[i:i + (1 << 16)]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(values)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp bigint) of every row of docs (doc_id, text)."""
    docs = pick(docs, "doc_id", "text")

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([fingerprint(t or "") for t in strings(b, "text")], pa.int64())], names=["doc_id", "fp"])

    return arrow_map(docs, run, f"doc_id {docs.schema[0].dataType.simpleString()}, fp bigint")


def _masks() -> list[int]:
    ends = np.cumsum([0, *SEGMENTS]).tolist()
    return [((1 << ends[i + 1]) - (1 << ends[i])) for i in range(len(SEGMENTS))]


def _signed(m: int) -> int:
    return m - (1 << 64) if m >= 1 << 63 else m


def _in_budget(start: Column, x: Column) -> Column:
    """Do all chains from segment `start` keep their budgets of the differing bits x?"""
    masks, m = _masks(), len(SEGMENTS)
    ok = F.lit(False)
    for i in range(m):
        rule, held = F.lit(True), 0
        for length in range(1, m + 1):
            held |= masks[(i + length - 1) % m]
            rule = rule & (F.bit_count(x.bitwiseAND(F.lit(_signed(held)).cast("bigint"))) <= BITS_APART * length // m)
        ok = ok | ((start == i) & rule)
    return ok


def links(classes: DataFrame) -> DataFrame:
    """(a, b) with a < b: fingerprints (column fp, distinct) at most two bits apart, all of them but
    for crowded keys, where a chain joins those around a common neighbour."""
    masks, m = _masks(), len(SEGMENTS)
    fp = F.col("fp")
    keys = stage(classes.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("start"), fp.bitwiseAND(F.lit(_signed(masks[i] | masks[(i + 1) % m])).cast("bigint")).alias("key"))
        for i in range(m)])).alias("k")).select("fp", "k.start", "k.key"))
    many = keys.groupBy("start", "key").count().where("count > 1")
    crowded = known_size(many.where(F.col("count") > CROWD).select("start", "key"))
    calm = keys.join(crowded, ["start", "key"], "left_anti")
    a, b = calm.select("start", "key", F.col("fp").alias("a")), calm.select("start", "key", F.col("fp").alias("b"))
    x = F.col("a").bitwiseXOR(F.col("b"))
    pairs = (a.join(b, ["start", "key"]).where("a < b").where(_in_budget(F.col("start"), x))
             .where(F.bit_count(x) <= BITS_APART).select("a", "b"))
    thick = keys.join(crowded, ["start", "key"], "left_semi").select("fp").distinct()
    flips = F.array(F.lit(0).cast("bigint"), *[F.lit(_signed(1 << i)).cast("bigint") for i in range(64)])
    around = (thick.select("fp", F.explode(flips).alias("flip")).select("fp", fp.bitwiseXOR(F.col("flip")).alias("n"))
              .groupBy("n").agg(F.sort_array(F.collect_set("fp")).alias("g")).where(F.size("g") > 1)
              .select(F.explode(F.arrays_zip(F.expr("slice(g, 1, size(g) - 1)").alias("a"), F.expr("slice(g, 2, size(g) - 1)").alias("b"))).alias("p"))
              .select(F.col("p.a").alias("a"), F.col("p.b").alias("b")))
    return pairs.unionByName(around).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of every row of docs (doc_id, text)."""
    prints = stage(fingerprints(docs))
    classes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    comps = components(links(classes.select("fp")))
    named = (classes.join(comps.withColumnRenamed("node", "fp"), "fp", "left")
             .withColumn("component", F.coalesce("component", "fp")))
    lowest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    ids = known_size(named.join(lowest, "component").select("fp", "component_id"))
    return prints.join(ids, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: its smallest doc_id (nulls last), then the smallest text
    hash, then the smallest of the other columns."""
    d = docs.toDF(*[f"_{i}" for i in range(len(docs.columns))])
    id_, text = (F.col(f"_{docs.columns.index(n)}") for n in ("doc_id", "text"))
    at = F.xxhash64(text)
    named = d.select(F.struct(id_.isNull().alias("none"), id_.alias("id"), at.alias("at")).alias("doc_id"), text.alias("text"))
    first = known_size(near_duplicates(named).where(F.col("doc_id") == F.col("component_id"))
                       .groupBy(F.col("doc_id.id").alias("id"), F.col("doc_id.at").alias("at")).agg(F.count("*").alias("rows")))
    kept = d.join(first, F.col("id").eqNullSafe(id_) & (F.col("at") == at))
    alone = kept.where("rows = 1").select(*d.columns)
    # rows that share id and text: one is taken after partial minima
    again = (kept.where("rows > 1").groupBy("id", "at").agg(F.min(F.struct(*d.columns)).alias("row")).select("row.*"))
    return alone.unionByName(again).toDF(*docs.columns)


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
