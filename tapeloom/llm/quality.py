"""Quality scores: ridge regression on random Fourier features of document statistics, calibrated by
isotonic regression.

Statistics of a whole text are numbers in [0, 1] (lengths on a log scale, shares of kinds of characters,
words and lines, repetition, entropy), kept as whole 1/SCALE. They are made once for all rows. Labelled
training rows are standardised and mapped to cosines of random projections, whose inner products
approximate a Gaussian kernel. Each task sums the normal equations of its rows, for each fold; features
are rounded to whole 1/SCALE too, so sums are exact and the same however the rows are partitioned. Sums
of tasks are added in partitions by row of the matrix; the driver gets one matrix for each fold, whose
size depends on FEATURES alone. Every training row is scored by the model of the other folds, and scores
on a grid of GRID steps, with counts and labels, are pooled into a rising curve; a score is read off that
curve, linear between the middles of its steps.

Null and empty texts have all statistics 0 and get a score like others. Rows without a label (or with a
null one) are scored but not learned from; several labels of a document all count, and repeated rows
count as often as they occur; null ids have no label. Without training rows every score is 0.5; with one
label only it is that label. An empty table gives an empty result.
"""
from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import arrow_map, pick, strings

SCALE, FEATURES, FOLDS, GRID = 1 << 12, 256, 3, 1 << 12
#: The kernel's width in standard deviations of one statistic, for each of them; the ridge per row.
WIDTH, RIDGE, SEED = 1.5, 1e-4, 11
#: Rows that are mapped and multiplied at once.
BLOCK = 2048
ACCEPT = 0.7
_MARKS = re.compile(r"[^\w\s]{2,}(?=\s|$)")
_BYTES = np.zeros((256, 8))
for _i, _set in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\n\r\x0b\x0c", b".,;:'\"-()",
                           b"!?", b"#$%&*+/<=>@[\\]^_`{|}~", bytes(range(128, 256)))):
    _BYTES[list(_set), _i] = 1
STATISTICS = ("chars", "words", "lines", "ascii_upper", "ascii_lower", "digit", "white", "stop", "shout", "symbol", "wide", "entropy", "word_length",
              "word_spread", "distinct", "commonest", "stutter", "trigrams", "upper_words", "marked_words", "letterless", "line_length", "repeated_lines",
              "open_lines")


def _log(n: float, most: float) -> float:
    return min(1.0, math.log1p(n) / math.log1p(most))


def statistics(text: str | None) -> list[float]:
    """The statistics of a text, each in [0, 1], in the order of STATISTICS."""
    if not text:
        return [0.0] * len(STATISTICS)
    raw = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = counts[counts > 0] / len(raw)
    kinds = (counts @ _BYTES / len(raw)).tolist()
    words = text.split()
    lines = [x for x in map(str.strip, text.split("\n")) if x]
    n, m = len(words), len(lines)
    out = [_log(len(text), 1e6), _log(n, 2e5), _log(m, 1e4), *kinds, float(-(share * np.log2(share)).sum()) / 8]
    if not n:
        return out + [0.0] * (len(STATISTICS) - len(out))
    lengths = np.fromiter(map(len, words), np.float64, n)
    seen = Counter(words)
    threes = n - 2
    out += [_log(float(lengths.mean()), 100), _log(float(lengths.std()), 100), len(seen) / n, max(seen.values()) / n,
            sum(map(eq, words, words[1:])) / n, len(set(zip(words, words[1:], words[2:]))) / threes if threes > 0 else 1.0,
            sum(map(str.isupper, words)) / n, min(1.0, len(_MARKS.findall(text)) / n), sum(not any(map(str.isalpha, w)) for w in words) / n,
            _log(len(text) / m, 1e4), 1 - len(set(lines)) / m, sum(x[-1] not in ".!?" for x in lines) / m]
    return out


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, stats array<int>) of every row of docs (doc_id, text)."""
    d = pick(docs, "doc_id", "text")

    def run(batches):
        for b in batches:
            made = [[round(SCALE * x) for x in statistics(t)] for t in strings(b, "text")]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.list_(pa.int32()))], names=["doc_id", "stats"])

    return arrow_map(d, run, f"doc_id {d.schema[0].dataType.simpleString()}, stats array<int>")


@dataclass(frozen=True)
class Features:
    """Random Fourier features of standardised statistics, with a constant in front."""
    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phases: np.ndarray

    @staticmethod
    def over(mean: np.ndarray, deviation: np.ndarray) -> "Features":
        rng = np.random.default_rng(SEED)
        k = len(mean)
        waves = rng.standard_normal((k, FEATURES)) / (WIDTH * math.sqrt(k))
        return Features(mean, 1 / np.maximum(deviation, 8 / SCALE), waves, rng.uniform(0, 2 * math.pi, FEATURES))

    def of(self, stats: np.ndarray) -> np.ndarray:
        """Whole numbers, as floats: rows of 1/SCALE."""
        # statistics far outside what was seen count as far, not as anywhere on the wave
        x = np.clip((stats / SCALE - self.mean) * self.scale, -8, 8)
        return np.concatenate([np.full((len(x), 1), float(SCALE)), np.rint(SCALE * np.cos(x @ self.waves + self.phases))], axis=1)


@dataclass(frozen=True)
class Model:
    features: Features | None
    weights: np.ndarray | None
    knots: tuple[np.ndarray, np.ndarray]

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.features is None:
            return np.full(len(stats), self.knots[1][0])
        return read_off(self.features.of(stats) @ self.weights, self.knots)


def read_off(raw: np.ndarray, knots: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return np.clip(np.interp(raw, *knots), 0, 1)


def isotonic(at: np.ndarray, n: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising curve nearest to the shares ones / n at the places `at` (ascending): pools of
    neighbours that fall, each at its mean place."""
    pools: list[list[float]] = []
    for x, k, y in zip(at.tolist(), n.tolist(), ones.tolist()):
        pools.append([x * k, k, y])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    p = np.array(pools)
    return p[:, 0] / p[:, 1], p[:, 2] / p[:, 1]


def normal_equations(rows: DataFrame, features: Features) -> np.ndarray:
    """Sums over rows (stats, fold, y) of the outer product of (features, SCALE * y) with itself, for
    each fold, in whole 1/SCALE^2. Exact while a fold has less than 2^38 rows."""
    sent = rows.sparkSession.sparkContext.broadcast(features)
    size = FEATURES + 2
    kind = pa.list_(pa.int64())

    def table(sums):
        return pa.RecordBatch.from_arrays(
            [pa.array(np.arange(FOLDS * size), pa.int32()), pa.array(list(sums.reshape(FOLDS * size, size)), kind)], names=["at", "sums"])

    def add(batches):
        sums = np.zeros((FOLDS, size, size), np.int64)
        for b in batches:
            stats, fold, y = _matrix(b.column(0)), b.column(1).to_numpy(), b.column(2).to_numpy()
            for i in range(0, len(stats), BLOCK):
                z = np.concatenate([sent.value.of(stats[i:i + BLOCK]), SCALE * y[i:i + BLOCK, None].astype(float)], axis=1)
                for f in range(FOLDS):
                    part = z[fold[i:i + BLOCK] == f]
                    sums[f] += (part.T @ part).astype(np.int64)  # whole numbers under 2^53
        yield table(sums)

    def merge(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for at, row in zip(b.column(0).to_pylist(), _matrix(b.column(1))):
                total[at] = total[at] + row if at in total else row.copy()
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), kind)], names=["at", "sums"])

    schema = "at int, sums array<bigint>"
    made = arrow_map(arrow_map(rows.select("stats", "fold", "y"), add, schema).repartition("at"), merge, schema).collect()
    out = np.zeros((FOLDS * size, size), np.int64)
    for r in made:
        out[r["at"]] = r["sums"]
    return out.reshape(FOLDS, size, size)


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def solve(sums: np.ndarray) -> np.ndarray:
    """Ridge weights for features in whole 1/SCALE; the constant is not held down."""
    a, b = sums[:-1, :-1] / SCALE ** 2, sums[:-1, -1] / SCALE ** 2
    held = np.eye(len(a)) * RIDGE * max(a[0, 0], 1)
    held[0, 0] = 1e-9
    return np.linalg.solve(a + held, b) / SCALE


def learn(stats: DataFrame, labels: DataFrame, fold: Column) -> Model:
    """Fit on rows of stats (doc_id, stats) that have a label in labels (doc_id, label) and a fold, a
    number under FOLDS (null: not learned from)."""
    known = labels.where("doc_id is not null and label is not null").select("doc_id", F.col("label").cast("int").alias("y"))
    rows = stage(stats.withColumn("fold", fold.cast("int")).where("fold is not null").join(known, "doc_id").select("stats", "fold", "y"))
    each = (rows.select("y", F.posexplode("stats").alias("at", "v")).groupBy("at")
            .agg(F.count("*").alias("n"), F.sum("y").alias("ones"), F.sum(F.col("v").cast("bigint")).alias("s"),
                 F.sum(F.col("v").cast("bigint") * F.col("v")).alias("q")).orderBy("at").collect())
    if not each or each[0]["ones"] in (0, each[0]["n"]):
        share = each[0]["ones"] / each[0]["n"] if each else 0.5
        return Model(None, None, (np.zeros(1), np.array([share])))
    n = each[0]["n"]
    mean = np.array([r["s"] for r in each]) / n / SCALE
    features = Features.over(mean, np.sqrt(np.maximum(np.array([r["q"] for r in each]) / n / SCALE ** 2 - mean ** 2, 0)))
    sums = normal_equations(rows, features)
    whole = sums.sum(axis=0)
    # a fold whose others have no rows is judged by the whole model
    weights = np.stack([solve(whole - s if whole[0, 0] > s[0, 0] else whole) for s in sums])
    sent = rows.sparkSession.sparkContext.broadcast((features, weights))

    def place(batches):
        f, w = sent.value
        for b in batches:
            raw = (f.of(_matrix(b.column(0))) * w[b.column(1).to_numpy()]).sum(axis=1)
            at = np.rint((np.clip(raw, -1, 2) + 1) / 3 * GRID).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), b.column(2)], names=["at", "y"])

    grid = (arrow_map(rows.select("stats", "fold", "y"), place, "at int, y int").groupBy("at")
            .agg(F.count("*").alias("n"), F.sum("y").alias("ones")).orderBy("at").collect())
    at, count, ones = (np.array([r[c] for r in grid], float) for c in ("at", "n", "ones"))
    return Model(features, solve(whole), isotonic(3 * at / GRID - 1, count, ones))


def scored(stats: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of stats (doc_id, stats)."""
    sent = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            s = np.concatenate([np.zeros(0), *[sent.value.score(_matrix(b.column(1).slice(i, BLOCK))) for i in range(0, b.num_rows, BLOCK)]])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], names=["doc_id", "score"])

    return arrow_map(stats.select("doc_id", "stats"), run, f"doc_id {stats.schema['doc_id'].dataType.simpleString()}, score double")


def quality(docs: DataFrame, labels: DataFrame, part: Column) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs (doc_id, text), learned from labels (doc_id,
    quality). `part` of doc_id: 2 is held out, 0, 1 and 3 are the folds learned from."""
    stats = stage(measured(docs))
    known = pick(labels, "doc_id", "quality").select("doc_id", F.col("quality").alias("label"))
    model = learn(stats, known, F.when(part < 2, part).when(part == 3, 2))
    return (scored(stats, model).withColumn("held_out", F.coalesce(part == 2, F.lit(False)))
            .withColumn("predicted", (F.col("score") >= ACCEPT).cast("int")).select("doc_id", "held_out", "score", "predicted"))
