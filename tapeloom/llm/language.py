"""Language identification with error-correcting output codes.

Each language has a codeword. For each bit a binary classifier over character n-grams tells the
languages whose bit is 1 from those whose bit is 0: a naive Bayes model, made of n-gram counts that
one aggregate over all training texts gives, so nothing is sampled. A text gets one margin for
each bit. Loss-weighted decoding adds up, for each codeword, the exponential loss of the margins,
weighted by how often that classifier is right on that language's training texts, and takes the
codeword with the least loss. A text is ambiguous if the second codeword is almost as near.

`und` with score 0 where the text is null or has no letter, or where nothing was learned. Rows whose
language is null are not learned from. With one learned language every text with a letter gets it,
with score 1. Ties go to the language that sorts first. Repeated rows count as often as they occur;
an empty table gives an empty result.
"""
from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch_of, pick, strings

ORDERS, BUCKETS = (1, 2, 3), 1 << 15
#: Characters hashed at once; margins take a row of log odds for each n-gram of a slice.
SLICE = 1 << 17
MARGIN = 0.02
LETTER = re.compile(r"[^\W\d_]")
_ODD = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
#: ASCII characters other than letters read as space.
_PLAIN = np.array([c if chr(c).isalpha() else 32 for c in range(128)], np.uint32)


def has_letter(text: str | None) -> bool:
    """str.isalpha is true for exactly the categories L*; the pattern only finds where to look."""
    return bool(text) and any(m[0].isalpha() for m in LETTER.finditer(text))


def grams(texts: list[str]):
    """(text number, buckets) of slices of the texts; every n-gram lies in one slice, and those of
    several short texts come together. Bucket BUCKETS stands for n-grams across two texts."""
    def cut():
        held, size = [], 0
        for i, t in enumerate(texts):
            t = f" {t.lower()} "
            for at in range(0, max(1, len(t) - 2), SLICE):
                part = t[at:at + SLICE + 2]
                new = (i, part, at + SLICE + 2 < len(t))
                if held and size + len(part) > SLICE:
                    yield held
                    held, size = [], 0
                held.append(new)
                size += len(part)
        if held:
            yield held

    for held in cut():
        raw = "\0\0".join(p for _, p, _ in held).encode("utf-32-le", "surrogatepass")
        c = np.frombuffer(raw, np.uint32)
        c = np.where(c < 128, np.where(c == 0, 0, _PLAIN[np.minimum(c, 127)]), c).astype(np.uint64)
        lengths = np.array([len(p) for _, p, _ in held])
        owner = np.repeat(np.array([i for i, _, _ in held]), lengths + 2)[:len(c)]
        out = []
        for n in ORDERS:
            h = np.full(len(c), n, np.uint64)
            bad = np.zeros(len(c), bool)
            for k in range(n):
                x = np.concatenate([c[k:], np.zeros(k, np.uint64)])
                h = (h ^ x) * np.uint64(_ODD[k]) & np.uint64(0xFFFFFFFF)
                h ^= h >> np.uint64(15)
                bad |= x == 0
            h = (h % BUCKETS).astype(np.int64)
            h[bad] = BUCKETS
            out.append(h)
        # an n-gram that starts in the overlap of a sliced text belongs to the next slice
        last = np.cumsum(lengths + 2) - 2
        for (_, _, more), end in zip(held, last):
            if more:
                for h in out:
                    h[end - 2:end] = BUCKETS
        yield owner, out


def code_matrix(languages: int, seed: int = 7) -> np.ndarray:
    """Codewords of 1 and -1, a row for each language: all 2^(L-1) - 1 splits for few languages,
    else the random code with the largest least distance among some tries."""
    if languages < 2:
        return np.ones((languages, 0), np.int8)
    if languages <= 6:
        bits = 2 ** (languages - 1) - 1
        return np.array([[1 if i == 0 or (j >> (i - 1)) & 1 else -1 for j in range(bits)] for i in range(languages)], np.int8)
    rng, best, least = np.random.default_rng(seed), None, -1
    bits = int(np.ceil(10 * np.log2(languages)))
    for _ in range(200):
        m = rng.choice(np.array([-1, 1], np.int8), (languages, bits))
        m = m[:, np.abs(m.sum(axis=1 - 1)) < languages]
        d = (m.shape[1] - m.astype(int) @ m.T.astype(int)) // 2
        gap = d[~np.eye(languages, dtype=bool)].min()
        if gap > least:
            best, least = m, gap
    return best


@dataclass(frozen=True)
class Model:
    languages: list[str]
    codes: np.ndarray  # language, bit: 1 or -1
    ratios: np.ndarray  # bucket (one more for none), bit: log odds
    trust: np.ndarray | None = None  # language, bit: weights that sum to 1

    def margins(self, texts: list[str]) -> np.ndarray:
        """A margin in (-1, 1) for each text and bit: the mean log odds of its n-grams."""
        total, n = np.zeros((len(texts), self.codes.shape[1])), np.zeros(len(texts))
        for owner, hashed in grams(texts):
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            for h in hashed:
                total[owner[first]] += np.add.reduceat(self.ratios[h], first, axis=0)
                n[owner[first]] += np.add.reduceat(h < BUCKETS, first)
        return np.tanh(3 * total / np.maximum(n, 1)[:, None])

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(best language number, score, ambiguous) of each row of margins."""
        if len(self.languages) == 1:
            n = len(margins)
            return np.zeros(n, int), np.ones(n), np.zeros(n, bool)
        loss = np.stack([(self.trust[i] * np.exp(-self.codes[i] * margins)).sum(axis=1) for i in range(len(self.languages))], 1)
        near = np.exp(-4 * (loss - loss.min(axis=1, keepdims=True)))
        best = loss.argmin(axis=1)
        two = np.sort(loss, axis=1)[:, :2]
        return best, near.max(axis=1) / near.sum(axis=1), two[:, 1] - two[:, 0] < MARGIN


def learn(docs: DataFrame, learned: Column) -> Model:
    """Fit on the rows of docs (doc_id, text, lang) where `learned` holds and lang is not null. What
    reaches the driver is a count for each language and bucket, and a rate for each language and bit."""
    spark = docs.sparkSession
    train = docs.where(learned & F.col("lang").isNotNull() & F.col("text").isNotNull())
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])

    def count(batches):
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            lang, texts = strings(b, "lang"), strings(b, "text")
            names = sorted(set(lang))
            number = np.array([names.index(x) for x in lang])
            for name in names:
                counts.setdefault(name, np.zeros(BUCKETS + 1, np.int64))
            for owner, hashed in grams(texts):
                which = number[owner] * (BUCKETS + 1)
                for h in hashed:
                    made = np.bincount(which + h, minlength=len(names) * (BUCKETS + 1)).reshape(len(names), -1)
                    for name, row in zip(names, made):
                        counts[name] += row
        for name, row in counts.items():
            at = np.flatnonzero(row[:BUCKETS])
            yield batch_of(schema, [name] * len(at), at, row[at])

    counted = (arrow_map(train.select("lang", "text"), count, "lang string, bucket int, n bigint")
               .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas())
    languages = sorted(counted["lang"].unique().tolist())
    codes = code_matrix(len(languages))
    table = np.zeros((len(languages), BUCKETS))
    table[counted["lang"].map({x: i for i, x in enumerate(languages)}), counted["bucket"]] = counted["n"]
    # every language weighs the same on its side of a bit, however many texts it has
    share = (table + 0.5) / (table.sum(axis=1, keepdims=True) + 0.5 * BUCKETS) if len(languages) else table
    ratios = np.zeros((BUCKETS + 1, codes.shape[1]), np.float32)
    for j in range(codes.shape[1]):
        ratios[:BUCKETS, j] = np.log(share[codes[:, j] == 1].mean(axis=0) / share[codes[:, j] == -1].mean(axis=0))
    model = Model(languages, codes, ratios)
    if len(languages) < 2:
        return model
    sent = spark.sparkContext.broadcast(model)
    rates = pa.schema([("lang", pa.string()), ("n", pa.int64()), ("hits", pa.list_(pa.int64()))])

    def right(batches):
        m = sent.value
        n, hits = np.zeros(len(m.languages), np.int64), np.zeros(m.codes.shape, np.int64)
        for b in batches:
            at = np.array([m.languages.index(x) for x in strings(b, "lang")], int)
            good = np.sign(m.margins(strings(b, "text"))) == m.codes[at]
            np.add.at(n, at, 1)
            np.add.at(hits, at, good)
        yield batch_of(rates, m.languages, n, hits.tolist())

    each = (arrow_map(train.select("lang", "text"), right, "lang string, n bigint, hits array<bigint>")
            .select("lang", "n", F.posexplode("hits").alias("bit", "hit")).groupBy("lang", "bit")
            .agg((F.sum("hit") / F.sum("n")).alias("rate")).collect())
    trust = np.zeros(codes.shape)
    for r in each:
        trust[languages.index(r["lang"]), r["bit"]] = r["rate"]
    trust = np.maximum(trust, 1e-6)
    return Model(languages, codes, ratios, trust / trust.sum(axis=1, keepdims=True))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs (with a column text) and lang_pred, score, ambiguous."""
    columns = docs.columns
    if len({*columns, "lang_pred", "score", "ambiguous"}) < len(columns) + 3:
        raise ValueError("a column has the name of a result; select the ones to keep")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for b in batches:
            texts = strings(b, "text")
            ok = [i for i, t in enumerate(texts) if m.languages and has_letter(t)]
            lang, score, close = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
            if ok:
                best, s, a = m.decode(m.margins([texts[i] for i in ok]))
                score[ok], close[ok] = s, a
                for i, k in zip(ok, best.tolist()):
                    lang[i] = m.languages[k]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang), pa.array(score), pa.array(close)],
                                             names=[*columns, "lang_pred", "score", "ambiguous"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return arrow_map(docs, run, f"{kinds}, lang_pred string, score double, ambiguous boolean")


def keep_known(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang and others) without the rows whose language is `und`; lang is filled in
    where it is null. Learns as the query does, from rows with a language that are not held out. Where
    nothing can be learned all rows stay."""
    d = docs.toDF(*[f"_{i}" for i in range(len(docs.columns))])
    at = {n: f"_{docs.columns.index(n)}" for n in ("doc_id", "text", "lang")}
    model = learn(d.select(F.col(at["text"]).alias("text"), F.col(at["lang"]).alias("lang"), F.col(at["doc_id"]).alias("doc_id")),
                  ~held_out(F.col("doc_id")))
    if not model.languages:
        return docs
    made = identify(d.withColumn("text", F.col(at["text"])), model).where("lang_pred <> 'und'")
    return (made.withColumn(at["lang"], F.coalesce(at["lang"], "lang_pred")).select(*d.columns).toDF(*docs.columns))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
