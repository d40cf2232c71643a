"""Edit-distance fingerprints by a randomised embedding.

A walk shared by all texts reads a text from left to right. At each time step it writes the
character it stands on and moves to the next one or not, as a random bit of the pair (time,
character) says. After an edit two walks soon stand on equal characters again, so the Hamming distance of what they
write stays near the edit distance of the texts. With T[c, t], the steps from time t until the walk
leaves character c, one addition per character gives the whole walk.

A fingerprint samples bits of that output at times that all texts share: SAMPLES of the first
SAMPLES steps and of each octave after them, which keeps it short for very long texts and comparable
between texts of any length. It is a hex string of one block for each octave the walk reaches.

near_groups() finds texts of near fingerprints among all: each fingerprint is dealt by TABLES samples of
BITS bits of its last two octaves (texts whose lengths lie on two sides of an octave share one), those
that share a sample are compared on all their bits, and components of pairs of enough likeness are
groups. A sample that more than CROWD fingerprints share is not paired out: each is compared with the
sample's first, and they are dealt anew by that sample together with the two after it.

Null text counts as empty text; its fingerprint is the empty string. Equal texts have equal
fingerprints. Two empty fingerprints have likeness 1; one has likeness 0 to any other. Repeated rows
and tied ids give a row each; among equal ids, and last among all for null ids, rows are ordered by
text. An empty table gives an empty result; the only document is followed by itself.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import known_size, stage
from .common import arrow_map, components, pick, strings

#: Sampled steps of an octave; classes of characters with a walk of their own; period of the walks.
SAMPLES, CLASSES, PERIOD = 256, 1024, 4096
SEED = 20_417
OCTAVES = 40

TABLES, BITS, CROWD, LEAST = 32, 24, 64, 0.8

_random = np.random.default_rng(SEED)
_MOVES = _random.integers(0, 2, (CLASSES, PERIOD), dtype=np.uint8)
_MOVES[:, -1] = 1  # each walk leaves a character at the latest here
_BIT = _random.integers(0, 2, CLASSES, dtype=np.uint8)


def _stay() -> np.ndarray:
    """T[c, t]: steps, at least one, from time t until the walk leaves character c."""
    out = np.empty((CLASSES, PERIOD), np.int64)
    nxt = np.full(CLASSES, PERIOD)
    for t in range(PERIOD - 1, -1, -1):
        nxt = np.where(_MOVES[:, t] == 1, t, nxt)
        out[:, t] = nxt - t + 1
    return out.ravel().astype(np.uint16)


_STAY = _stay()
_STAY_VIEW = memoryview(_STAY)
#: Texts still being read below which they are walked one by one.
FEW = 24
#: Output bit of a character class at a time: mixes time in, so that repeated characters do not give
#: constant blocks.
_MIX = _random.integers(0, 2, PERIOD * 2, dtype=np.uint8)


def _times() -> list[np.ndarray]:
    out = [np.arange(SAMPLES)]
    for k in range(OCTAVES):
        low = SAMPLES << k
        out.append(np.sort(_random.choice(np.arange(low, 2 * low), SAMPLES, replace=False)) if low <= 1 << 16
                   else np.sort(low + _random.integers(0, low, SAMPLES)))
    return out


_TIMES = _times()
_SAMPLE = np.stack([_random.choice(SAMPLES, BITS, replace=False) for _ in range(TABLES)])


def _classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return (codes * 2_654_435_761 >> 7) % CLASSES


def walk(texts: list[np.ndarray], start: np.ndarray | None = None) -> list[np.ndarray]:
    """Times at which each walk reaches each character and at which it ends, for texts given as
    classes. The texts advance side by side, longest first, so each step is one gather."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    lengths = np.array([len(texts[i]) for i in order])
    now = np.zeros(len(texts), np.int64) if start is None else start[order].astype(np.int64)
    if not len(texts) or not lengths[0]:
        return [np.array([now[order.index(i)]]) for i in range(len(texts))]
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")  # texts longer than step
    flat = np.concatenate([texts[i] for i in order])
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    times = np.empty(len(flat), np.int64)
    for step, n in enumerate(active.tolist()):
        if n < FEW:
            for k in range(n):
                t, tail = int(now[k]), []
                for c in flat[first[k] + step:first[k] + lengths[k]].tolist():
                    tail.append(t)
                    t += _STAY_VIEW[c * PERIOD + t % PERIOD]
                times[first[k] + step:first[k] + lengths[k]] = tail
                now[k] = t
            break
        at = first[:n] + step
        t = now[:n]
        times[at] = t
        now[:n] = t + _STAY[flat[at] * PERIOD + t % PERIOD]
    out: list = [None] * len(texts)
    for k, i in enumerate(order):
        out[i] = np.append(times[first[k]:first[k] + lengths[k]], now[k])
    return out


def sample(classes: np.ndarray, times: np.ndarray) -> str:
    """The fingerprint of one walk."""
    if not len(classes):
        return ""
    blocks = 1
    while blocks <= OCTAVES and times[-1] > SAMPLES << (blocks - 1):
        blocks += 1
    when = np.concatenate(_TIMES[:blocks])
    at = np.searchsorted(times, when, "right") - 1
    over = at >= len(classes)
    c = classes[np.minimum(at, len(classes) - 1)]
    bits = np.where(over, _MIX[when % PERIOD], _BIT[(c * 31 + when) % CLASSES])
    return np.packbits(bits).tobytes().hex()


def fingerprints(texts: list[str]) -> list[str]:
    """Fingerprints of whole texts."""
    cls = [_classes(t) for t in texts]
    return [sample(c, t) for c, t in zip(cls, walk(cls))]


def likeness(a: str, b: str) -> float:
    """Share of the embedding's steps, of the longer text, on which two fingerprints agree beyond
    chance: blocks count by the steps they stand for."""
    if not a or not b:
        return float(a == b)
    if a == b:
        return 1.0
    x, y = (np.unpackbits(np.frombuffer(bytes.fromhex(s), np.uint8)).reshape(-1, SAMPLES) for s in (a, b))
    n, m = max(len(x), len(y)), min(len(x), len(y))
    weight = np.array([1, *(2.0 ** k for k in range(n - 1))])
    agree = np.zeros(n)
    agree[:m] = np.maximum(0, 2 * (x[:m] == y[:m]).mean(axis=1) - 1)
    return float(np.clip((weight * agree).sum() / weight.sum(), 0, 1))


# --- near texts -----------------------------------------------------------------------------------

def samples(fingerprint: str) -> list[int]:
    """TABLES samples for each of the last two blocks, with the block and table in front of the bits."""
    bits = np.unpackbits(np.frombuffer(bytes.fromhex(fingerprint), np.uint8)).reshape(-1, SAMPLES)
    out = []
    for b in range(max(0, len(bits) - 2), len(bits)):
        drawn = bits[b][_SAMPLE].astype(np.int64) @ (1 << np.arange(BITS))
        out += ((b * TABLES + np.arange(TABLES)) << BITS | drawn).tolist()
    return out


def near_groups(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, fingerprint, group_id) of every row of docs (doc_id, text): group_id is the smallest
    doc_id that links of likeness `least` or more reach. Equal texts are one class."""
    docs = pick(docs, "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def prints(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprints([t or "" for t in strings(b, "text")]), pa.string())],
                                             names=["doc_id", "fingerprint"])

    made = stage(arrow_map(docs, prints, f"doc_id {kind}, fingerprint string"))
    classes = stage(made.groupBy("fingerprint").agg(F.min("doc_id").alias("first")))

    def deal(batches):
        for b in batches:
            fps = strings(b, "fingerprint")
            drawn = [samples(f) for f in fps]
            at = pa.array(np.repeat(np.arange(len(fps)), [len(d) for d in drawn]), pa.int32())
            key = [k for d in drawn for k in d]
            more = [f"{d[i]} {d[(i + 1) % len(d)]} {d[(i + 2) % len(d)]}" for d in drawn for i in range(len(d))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array(key, pa.int64()), pa.array(more, pa.string())], names=["fp", "key", "more"])

    rows = (arrow_map(classes.select("fingerprint").where("fingerprint <> ''"), deal, "fp string, key bigint, more string")
            .select("fp", "key", F.xxhash64("more").alias("more")))
    pairs = None
    for level in range(2):
        shared = known_size(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("head")).where("n > 1"))
        rows = stage(rows.join(shared, "key"))
        calm, crowd = rows.where(F.col("n") <= CROWD), rows.where(F.col("n") > CROWD)
        found = (calm.select("key", F.col("fp").alias("a")).join(calm.select("key", F.col("fp").alias("b")), "key").where("a < b").select("a", "b")
                 .unionByName(crowd.where("fp <> head").select(F.col("head").alias("a"), F.col("fp").alias("b"))))
        pairs = found if pairs is None else pairs.unionByName(found)
        rows = crowd.select("fp", F.col("more").alias("key"), "more")

    def verify(batches):
        for b in batches:
            keep = [likeness(x, y) >= least for x, y in zip(strings(b, "a"), strings(b, "b"))]
            yield b.filter(pa.array(keep, pa.bool_()))

    comps = components(arrow_map(pairs.distinct(), verify, "a string, b string"))
    joined = (classes.join(comps.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
              .withColumn("component", F.coalesce("component", "fingerprint")))
    lowest = joined.groupBy("component").agg(F.min("first").alias("group_id"))
    ids = known_size(joined.join(lowest, "component").select("fingerprint", "group_id"))
    return made.join(ids, "fingerprint").select("doc_id", "fingerprint", "group_id")


# --- every document beside the next one ---------------------------------------------------------

def with_next(docs: DataFrame, fn, schema: str, parts: int | None = None) -> DataFrame:
    """fn(rows) over lists of (doc_id, text, next text), where next is the document after in
    descending doc_id order and the first after the last. Documents are dealt to ranges of doc_id;
    each range also gets the first document of the range after it, which is all that has to be
    copied, and rows stream through a task in order."""
    spark = docs.sparkSession
    docs = pick(docs, "doc_id", "text")
    parts = parts or 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    marks = docs.select(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 100 * parts)).first()[0] or []
    marks = sorted({m for m in marks})
    # bucket 0 has the largest ids; null ids come last of all
    edges = F.array(*[F.lit(m) for m in reversed(marks)]) if marks else None
    bucket = F.lit(0) if edges is None else F.size(F.filter(edges, lambda m: m >= F.coalesce("doc_id", F.lit(-(2 ** 63)))))
    placed = docs.withColumn("bucket", F.when(F.col("doc_id").isNull(), len(marks) + 1).otherwise(bucket))
    # the first document of each bucket: its largest id, and the first of the texts that share it
    tops = placed.groupBy("bucket").agg(F.max("doc_id").alias("top")).collect()
    used = sorted(r["bucket"] for r in tops)
    before = {b: used[i - 1] for i, b in enumerate(used)}
    heads = placed.join(F.broadcast(spark.createDataFrame([(r["bucket"], r["top"], before[r["bucket"]]) for r in tops],
                                                          "b int, top bigint, before int")) if tops else
                        spark.createDataFrame([], "b int, top bigint, before int"),
                        F.col("bucket").eqNullSafe(F.col("b")) & F.col("doc_id").eqNullSafe(F.col("top")))
    heads = (heads.groupBy("before").agg(F.min(F.struct(F.coalesce("text", F.lit("")).alias("text"))).alias("h"))
             .select(F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.col("h.text").alias("text"),
                     F.col("before").alias("bucket"), F.lit(True).alias("head")))
    rows = placed.withColumn("head", F.lit(False)).unionByName(heads)
    ordered = (rows.repartition(parts, "bucket")
               .sortWithinPartitions("bucket", "head", F.desc_nulls_last("doc_id"), F.coalesce("text", F.lit(""))))

    def run(batches):
        before = None
        for b in batches:
            out = []
            for doc, text, at, head in zip(*(strings(b, n) for n in ("doc_id", "text", "bucket", "head"))):
                if before is not None and before[2] == at:
                    out.append((before[0], before[1], text or ""))
                before = None if head else (doc, text or "", at)
            if out:
                yield fn(out)

    return arrow_map(ordered, run, schema)


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next):
    the fingerprint of each document and of its edited text, whose last half is replaced by the
    start of the next document."""
    doc_type = pick(docs, "doc_id").schema[0].dataType.simpleString()

    def run(rows):
        cls = [_classes(r[1]) for r in rows]
        after = [_classes(r[2]) for r in rows]
        times = walk(cls)
        half = [len(c) // 2 for c in cls]
        # the edited text's walk is the same up to the edit and goes on from there
        more = [a[:h] for a, h in zip(after, half)]
        tails = walk(more, np.array([t[len(c) - h] for t, c, h in zip(times, cls, half)], np.int64))
        prints = [sample(c, t) for c, t in zip(cls, times)]
        edited = [sample(np.concatenate([c[:len(c) - h], m]), np.concatenate([t[:len(c) - h], u]))
                  for c, t, h, m, u in zip(cls, times, half, more, tails)]
        nexts = prints[1:] + fingerprints([rows[-1][2]])
        nexts = [n if rows[i][2] == (rows[i + 1][1] if i + 1 < len(rows) else rows[i][2]) else fingerprints([rows[i][2]])[0]
                 for i, n in enumerate(nexts)]
        digests = [hashlib.sha256((t[:len(t) - len(t) // 2] + n[:len(t) // 2]).encode("utf-8", "surrogatepass")).hexdigest()
                   for _, t, n in rows]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([len(c) for c in cls], pa.int64()), pa.array(digests),
             pa.array(prints, pa.string()), pa.array(edited, pa.string()),
             pa.array([likeness(a, b) for a, b in zip(prints, edited)]),
             pa.array([likeness(a, b) for a, b in zip(prints, nexts)])],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return with_next(docs.withColumn("doc_id", F.col("doc_id").cast("bigint")) if doc_type != "bigint" else docs, run,
                     "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                     "near_edited double, near_next double")
