"""Benchmark decontamination by latent semantic retrieval.

Benchmark passages become TF-IDF vectors, whose document frequencies are counted over the whole
corpus. A distributed randomised SVD of the passages gives a latent space: tasks multiply their
passages with a random matrix, the partial products are summed by blocks of terms, and only the
(terms x rank) factor is orthonormalised on the driver. Windows of every document are projected into
that space and compared with all passages, in blocks: a candidate has a cosine of COSINE or more, and
its projection on the passage is at least HELD of the passage's length. A candidate is read word by word: the longest common subsequence must cover COVER of the passage, or PART of it together
with ANSWER of the words of its answer (a column `answer`, or else the last sentence).

Windows are one and a half times to twice as long as the passages they are compared with and overlap
such that each stretch of a passage's length lies whole in one of them. Words that more than COMMON of
the documents hold have no weight, unless a passage has fewer than SHORT others. Items of over PASSAGE words are cut into
even passages and leak if one of them does. Passages are taken in blocks of BLOCK, no more than the
space has dimensions, so none is lost in it; each block has its own pass over the documents, and what
tasks are sent does not grow with the benchmark.

Words are lower-cased stretches without white space and MARKS. Null or empty documents and items match nothing. Items of fewer than SHORT
words match word for word only. Repeated rows of documents give one row each per item; repeated items
with equal ids give one row. Rows with null ids are treated as any other. Ties of windows go to the
first. Empty tables give an empty result.
"""
from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import known_size, stage
from .common import arrow_map, batch_of, pick, strings

PASSAGE, BLOCK, SHORT = 128, 256, 8
RANK, OVERSAMPLE = 256, 16
#: Longest passage, window and hop of each scale, in words.
SCALES = ((16, 32, 16), (32, 48, 16), (64, 96, 32), (128, 192, 64))
STEP = 16
COSINE, HELD, COMMON = 0.3, 0.4, 0.1
COVER, PART, ANSWER = 0.8, 0.6, 0.8
MARKS = ".,;:!?\"'`()[]{}<>/\\|-_*#%&$@+=~^…–—“”„‘’«»¿¡·•。，、？！"
#: Words that are projected at once; characters split at once.
CHUNK, SLICE = 1 << 14, 1 << 22
_SPACE = re.compile(r"\s")


def words_of(text: str) -> list[str]:
    for m in MARKS:
        if m in text:
            text = text.replace(m, " ")
    return text.lower().split()


def parts(text: str):
    """Slices of a text, cut at white space."""
    at = 0
    while len(text) - at > SLICE:
        m = _SPACE.search(text, at + SLICE)
        if not m:
            break
        yield text[at:m.start()]
        at = m.end()
    yield text[at:] if at else text


def numbers(text: str, vocabulary: dict[str, int]) -> np.ndarray:
    """The words of a text as numbers, 0 for words that are not in the vocabulary."""
    out = []
    for p in parts(text):
        w = words_of(p)
        out.append(np.fromiter(map(vocabulary.get, w, repeat(0)), np.int32, len(w)))
    return out[0] if len(out) == 1 else np.concatenate(out)


def numbered(words: list[str]) -> dict[str, int]:
    return {w: i + 1 for i, w in enumerate(words)}


def passages(items: DataFrame) -> DataFrame:
    """(item_id, part, words, answer): the words of each passage and the number of words at its end
    that are the answer."""
    has = "answer" in items.columns
    items = pick(items, "item_id", "text", *(["answer"] if has else []))
    kind = items.schema["item_id"].dataType.simpleString()

    def cut(batches):
        for b in batches:
            out = ([], [], [], [])
            for i, (item, text) in enumerate(zip(b.column(0).to_pylist(), strings(b, "text"))):
                words = words_of(text or "")
                given = b.column(2)[i].as_py() if has else None
                tail = words_of(given or re.split(r"(?<=[.!?])\s+", (text or "").strip())[-1])
                if given:
                    words += tail
                n = -(-len(words) // PASSAGE)
                for k in range(n):
                    part = words[len(words) * k // n:len(words) * (k + 1) // n]
                    for col, v in zip(out, (item, k, part, min(len(tail), len(part)) if k == n - 1 else 0)):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], b.schema.types[0]), pa.array(out[1], pa.int32()),
                                              pa.array(out[2], pa.list_(pa.string())), pa.array(out[3], pa.int32())],
                                             names=["item_id", "part", "words", "answer"])

    return arrow_map(items, cut, f"item_id {kind}, part int, words array<string>, answer int").dropDuplicates(["item_id", "part", "words"])


def document_frequencies(docs: DataFrame, words: list[str]) -> tuple[int, np.ndarray]:
    """(documents, documents that hold each word), over the whole corpus."""
    sent = docs.sparkSession.sparkContext.broadcast(words)
    schema = pa.schema([("word", pa.int32()), ("n", pa.int64())])

    def count(batches):
        vocabulary, total = numbered(sent.value), np.zeros(len(sent.value) + 1, np.int64)
        for b in batches:
            for text in strings(b, "text"):
                seen = np.zeros(len(total), np.int64)
                seen[numbers(text or "", vocabulary)] = 1
                seen[0] = 1  # counts documents
                total += seen
        at = np.flatnonzero(total)
        yield batch_of(schema, at, total[at])

    rows = arrow_map(pick(docs, "text"), count, "word int, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(len(words) + 1, np.int64)
    for r in rows:
        total[r["word"]] = r["n"]
    return int(total[0]), total


def summed(rows: DataFrame, size: tuple[int, int]) -> np.ndarray:
    """The sum of float blocks (at, block) of whole matrices of `size`; tasks have summed theirs."""
    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.float64) for x in table.column("block"))
        return pa.table({"at": table.column("at")[:1], "block": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros(size)
    for r in rows.groupBy("at").applyInArrow(add, "at int, block binary").collect():
        block = np.frombuffer(r["block"], np.float64).reshape(-1, size[1])
        out[r["at"]:r["at"] + len(block)] = block
    return out


def latent_space(vectors: DataFrame, terms: int, rank: int = RANK, seed: int = 11) -> np.ndarray:
    """(terms, rank): leading right singular vectors of the rows (term array<int>, weight
    array<double>) by a randomised range finder with one power step."""
    width = min(rank + OVERSAMPLE, terms)
    sc = vectors.sparkSession.sparkContext

    def through(basis: np.ndarray, square: bool) -> np.ndarray:
        """AᵀA·basis, or (A·basis)ᵀ(A·basis)."""
        sent = sc.broadcast(basis)

        def run(batches):
            m = sent.value
            total = np.zeros((m.shape[1], m.shape[1]) if square else m.shape)
            for b in batches:
                for t, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    y = np.asarray(w) @ m[t]
                    if square:
                        total += np.outer(y, y)
                    else:
                        total[t] += np.outer(w, y)
            starts = range(0, len(total), 1024)
            yield pa.RecordBatch.from_arrays([pa.array(list(starts), pa.int32()), pa.array([total[i:i + 1024].tobytes() for i in starts], pa.binary())],
                                             names=["at", "block"])

        n = basis.shape[1] if square else terms
        return summed(arrow_map(vectors.select("term", "weight"), run, "at int, block binary"), (n, basis.shape[1]))

    basis = np.random.default_rng(seed).standard_normal((terms, width))
    for _ in range(2):
        basis = np.linalg.qr(through(basis, False))[0]
    value, vector = np.linalg.eigh(through(basis, True))
    keep = [i for i in np.argsort(-value)[:rank] if value[i] > 1e-9 * max(value.max(), 1e-300)]
    return basis @ vector[:, keep]


@dataclass(frozen=True)
class Passage:
    item: int
    words: np.ndarray
    answer: int

    @property
    def masks(self) -> dict[int, int]:
        out: dict[int, int] = {}
        for i, w in enumerate(self.words.tolist()):
            out[w] = out.get(w, 0) | 1 << i
        return out


def common(masks: dict[int, int], length: int, words: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel: bits of v fall where a match ends."""
    full = v = (1 << length) - 1
    for w in words:
        if m := masks.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return length - v.bit_count()


@dataclass(frozen=True)
class Index:
    words: list[str]
    project: np.ndarray  # word number (0: none), rank
    told: np.ndarray  # does the word have a weight?
    items: list
    passages: list[Passage]
    scales: list[tuple[int, int, np.ndarray, np.ndarray]]  # window and hop in steps, numbers of passages, their vectors

    def near(self, texts: list[np.ndarray]):
        """(text, passage, first word, end, cosine) of windows close to a passage."""
        lengths = np.array([-(-len(t) // STEP) for t in texts])
        starts = np.concatenate([[0], np.cumsum(lengths)])
        flat = np.zeros(starts[-1] * STEP, np.int32)
        for t, at in zip(texts, starts):
            flat[at * STEP:at * STEP + len(t)] = t
        # a word said again at once counts once
        told = np.flatnonzero(self.told[flat] & np.concatenate([[True], flat[1:] != flat[:-1]]))
        if not len(told):
            return
        step = told // STEP
        first = np.flatnonzero(np.concatenate([[True], step[1:] != step[:-1]]))
        run = np.zeros((len(flat) // STEP + 1, self.project.shape[1]), np.float32)
        run[step[first] + 1] = np.add.reduceat(self.project[flat[told]], first, axis=0)
        np.cumsum(run, axis=0, out=run)
        owner, end = np.repeat(np.arange(len(texts)), lengths), np.repeat(starts[1:], lengths)
        inner = np.arange(len(owner)) - np.repeat(starts[:-1], lengths)
        for long, hop, number, vectors in self.scales:
            begin = np.flatnonzero(inner % hop == 0)
            last = np.minimum(begin + long, end[begin])
            x = run[last] - run[begin]
            length = (vectors * vectors).sum(axis=1)
            inside = x @ vectors.T
            w, p = np.nonzero(inside >= HELD * length)
            cosine = inside[w, p] / np.sqrt(np.maximum((x[w] * x[w]).sum(axis=1) * length[p], 1e-12))
            w, p, cosine = w[cosine >= COSINE], p[cosine >= COSINE], cosine[cosine >= COSINE]
            base = starts[owner[begin[w]]]
            yield from zip(owner[begin[w]].tolist(), number[p].tolist(), ((begin[w] - base) * STEP).tolist(),
                           ((last[w] - base) * STEP).tolist(), cosine.tolist())

    def check(self, number: int, text: np.ndarray, first: int, end: int, masks) -> tuple[float, float] | None:
        """(cover, cover of the answer) if the window holds the passage."""
        p = self.passages[number]
        n = len(p.words)
        more = (end - first) // 4
        window = text[max(0, first - more):end + more]
        if n < SHORT:
            hit = any(np.array_equal(window[i:i + n], p.words) for i in np.flatnonzero(window == p.words[0]).tolist())
            return (1.0, 1.0) if hit else None
        window = window[window > 0].tolist()
        cover = common(masks[number], n, window) / n
        if cover < PART:
            return None
        tail = 1.0
        if p.answer:
            keep, shift = ((1 << n) - 1) >> (n - p.answer), n - p.answer
            tail = common({w: m >> shift & keep for w, m in masks[number].items()}, p.answer, window) / p.answer
        return (cover, tail) if cover >= COVER or tail >= ANSWER else None


def build(docs: DataFrame, block: list, items: list) -> Index:
    """The latent index of the passages of one block, rows of passages()."""
    spark = docs.sparkSession
    words = sorted({w for r in block for w in r["words"]})
    number = numbered(words)
    n, held = document_frequencies(docs, words)
    common = held > COMMON * n
    for r in block:
        at = [number[w] for w in r["words"]]
        if len(at) - common[at].sum() < SHORT:
            common[at] = False
    idf = np.where(common, 0.0, np.log((n + 1) / (held + 1)) + 1e-3)
    idf[0] = 0
    counted = [Counter(number[w] for w in r["words"]) for r in block]
    rows = [([*c], [float((1 + np.log(f)) * idf[t]) for t, f in c.items()]) for c in counted]
    vectors = stage(spark.createDataFrame([(t, w) for t, w in rows], "term array<int>, weight array<double>"))
    space = latent_space(vectors, len(words) + 1)
    project = (space * idf[:, None]).astype(np.float32)
    at = np.stack([np.asarray(w) @ space[t] for t, w in rows]).astype(np.float32)
    found = [Passage(i, np.array([number[w] for w in r["words"]], np.int32), r["answer"]) for i, r in enumerate(block)]
    scales, low = [], 0
    for size, window, hop in SCALES:
        those = np.array([i for i, p in enumerate(found) if low < len(p.words) <= size], int)
        if len(those):
            scales.append((window // STEP, hop // STEP, those, at[those]))
        low = size
    return Index(words, project, idf > 0, items, found, scales)


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, first_word, cosine, cover, answer) for each row of docs (doc_id, text) and
    item of items (item_id, text and maybe answer) that it holds; first_word is the start of the best window."""
    docs = pick(docs, "doc_id", "text")
    spark = docs.sparkSession
    doc_type, item_type = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    kinds = f"doc_id {doc_type}, item_id {item_type}, first_word bigint, cosine double, cover double, answer double"
    cut = stage(passages(items))
    kind = to_arrow_type(items.schema["item_id"].dataType)
    if cut.count() <= BLOCK:
        block = cut.orderBy("item_id", "part", "words").collect()
        return _search(docs, build(docs, block, [r["item_id"] for r in block]), kinds, kind) if block else spark.createDataFrame([], kinds)
    # rows that repeat id and text find the same in each block, so their number is that of any block
    named = docs.select(F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("at")).alias("doc_id"), "text")
    of_named = kinds.replace(f"doc_id {doc_type}", f"doc_id struct<id:{doc_type},at:bigint>", 1)
    found = None
    for k, block in enumerate(_blocks(cut)):
        more = _search(named, build(docs, block, [r["item_id"] for r in block]), of_named, kind).withColumn("block", F.lit(k))
        found = more if found is None else found.unionByName(more)
    best = F.max_by(F.struct("first_word", "cosine", "cover", "answer"), F.struct("cover", "cosine")).alias("best")
    return (found.groupBy("doc_id", "item_id", "block").agg(F.count("*").alias("rows"), best)
            .select("doc_id", "item_id", "rows", "best.*").groupBy("doc_id", "item_id").agg(F.max("rows").alias("rows"), best)
            .select("doc_id.id", "item_id", "best", F.explode(F.sequence(F.lit(1), F.col("rows"))))
            .select(F.col("id").alias("doc_id"), "item_id", "best.*"))


def _blocks(cut: DataFrame):
    """Lists of BLOCK passages, the last of fewer; they are fetched by shares of about as many."""
    shares, held = -(-cut.count() // BLOCK), []
    for k in range(shares):
        held += cut.where(F.pmod(F.xxhash64("item_id", "part", "words"), F.lit(shares)) == k).orderBy("item_id", "part", "words").collect()
        while len(held) >= BLOCK:
            yield held[:BLOCK]
            held = held[BLOCK:]
    if held:
        yield held


def _search(docs: DataFrame, index: Index, kinds: str, item_type: pa.DataType) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        ix = sent.value
        vocabulary, masks = numbered(ix.words), [p.masks for p in ix.passages]

        def search(texts):
            best = {}
            for t, p, first, end, cosine in ix.near(texts):
                old = best.get((t, ix.items[p]))
                if old and old[3] == 1 and old[1] >= cosine:
                    continue
                if got := ix.check(p, texts[t], first, end, masks):
                    new = (first, cosine, *got)
                    if old is None or (new[2], new[1]) > (old[2], old[1]):
                        best[t, ix.items[p]] = new
            return best

        def whole(text):
            """Chunks of a long text overlap by the longest window and what is read around it."""
            over, best, at = 4 * SCALES[-1][1], {}, 0
            while True:
                for (_, item), (first, cosine, cover, answer) in search([text[at:at + CHUNK]]).items():
                    old = best.get(item)
                    if old is None or (cover, cosine) > (old[2], old[1]):
                        best[item] = (first + at, cosine, cover, answer)
                if at + CHUNK >= len(text):
                    return best
                at += CHUNK - over

        for b in batches:
            docs_, texts = b.column(0), strings(b, "text")
            out, held, size = [], [], 0

            def flush():
                nonlocal held, size
                for (t, item), v in search([x for _, x in held]).items():
                    out.append((held[t][0], item, *v))
                held, size = [], 0

            for i, text in enumerate(texts):
                x = numbers(text or "", vocabulary)
                if len(x) > CHUNK:
                    out += [(i, item, *v) for item, v in whole(x).items()]
                elif len(x):
                    held.append((i, x))
                    size += len(x)
                    if size > CHUNK:
                        flush()
            if held:
                flush()
            out.sort(key=lambda r: r[0])
            cols = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([docs_.take(pa.array(cols[0], pa.int32())), pa.array(cols[1], item_type), pa.array(cols[2], pa.int64()),
                                              *(pa.array(c, pa.float64()) for c in cols[3:])],
                                             names=["doc_id", "item_id", "first_word", "cosine", "cover", "answer"])

    return arrow_map(docs, run, kinds)


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that hold no item, with all their columns. A document goes by id and text, so
    that rows that share an id are judged on their own."""
    named = docs.toDF(*[f"_{i}" for i in range(len(docs.columns))])
    id_, text = (F.col(f"_{docs.columns.index(n)}") for n in ("doc_id", "text"))
    marked = named.select(F.struct(id_.alias("id"), F.xxhash64(text).alias("at")).alias("doc_id"), text.alias("text"))
    bad = stage(leaks(marked, items)).select(F.col("doc_id.id").alias("id"), F.col("doc_id.at").alias("at")).distinct()
    kept = named.join(known_size(bad), F.col("id").eqNullSafe(id_) & (F.col("at") == F.xxhash64(text)), "left_anti")
    return kept.toDF(*docs.columns)

