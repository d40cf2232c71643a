"""Repeated paragraphs by banded MinHash.

A paragraph is a line of at least MIN_WORDS words, compared by its lower-cased words without the
signs at their ends. Paragraphs with equal words are one class before anything is compared, so copies
cost one partial sum. BANDS x ROWS MinHash values of the five-word shingles give the band keys: at a
Jaccard similarity of 0.8 two classes share a key with probability 1 - (1 - 0.8^4)^16 = 0.9998.
Classes with a common key are joined and their similarity is computed exactly from their words.

A key that more than CROWD classes share is not paired out. Each of its classes is compared with the
key's pivot, the class with the most distinct shingles. Those not linked to it are compared with one
another and with all linked ones that the triangle inequality leaves, in blocks, of which each gives
only the links that join components; so a crowded key loses no link. Links are pairs of classes of
similarity THRESHOLD or more; components of links are the clusters. The first paragraph of a cluster,
by doc_id (nulls last), text hash and place, stays and all others go.

Passages inside longer lines or across line breaks are found by passages.py; with_passages() gives both and
remove_repeats() removes both. What it leaves is not looked through again.

A document is named by doc_id and a hash of its text: rows that repeat both are one document, and
every such row gets the same paragraphs removed. Null or empty texts have no paragraphs and stay as
they are. Empty tables give empty results. Other columns are carried along by place, whatever their names.
"""
from __future__ import annotations

import re
import string

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from ..session import known_size, stage
from .common import FILTER, arrow_map, components, filter_of, may_hold, strings

MIN_WORDS, SHINGLE, THRESHOLD = 20, 5, 0.8
BANDS, ROWS, CROWD = 16, 4, 64
#: Classes of a crowded key in a block; two blocks are compared in a task.
BLOCK = 512
#: Shingles hashed at once; entries of a worker's memo of words; digests a task remembers.
CHUNK, MEMO, SEEN = 1 << 15, 1 << 18, 1 << 18
_ENDS, _SIGNS = re.compile(r"^[\W_]+|[\W_]+$"), string.punctuation
_rng = np.random.default_rng(29)
_MUL = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_WEIGH = _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)
_SPOT = 0x9E3779B1


def plain(token: str) -> str:
    """The lower-cased token without the signs at its ends. The pattern runs where ASCII signs are not all of them."""
    low = token.lower()
    if low.isalnum():
        return low
    w = low.strip(_SIGNS)
    return w if not w or w[0].isalnum() and w[-1].isalnum() else _ENDS.sub("", low)


def word_hash(w: str) -> int:
    try:
        return xxh3_64_intdigest(w)
    except UnicodeEncodeError:  # single surrogates
        return xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))


class Words(dict):
    """token -> its plain word; emptied when full."""

    def __missing__(self, token: str) -> str:
        w = plain(token)
        if len(self) >= MEMO:
            self.clear()
        if len(token) <= 64:
            self[token] = w
        return w

    def of(self, line: str) -> list[str]:
        return [w for w in map(self.__getitem__, line.split()) if w]


def digest(words: str) -> int:
    """Signed 64-bit name of a class."""
    h = word_hash(words)
    return h - (1 << 64) if h >> 63 else h


class Numbers(dict):
    """word -> 64-bit hash; emptied when full."""

    def __missing__(self, w: str) -> int:
        h = word_hash(w)
        if len(self) >= MEMO:
            self.clear()
        self[w] = h
        return h


def paragraphs(text: str, words: Words):
    """(place of the line, its plain words as one string, and as a list) of the long lines of a text."""
    for i, line in enumerate(text.split("\n")):
        if len(line) >= 2 * MIN_WORDS - 1:
            w = words.of(line)
            if len(w) >= MIN_WORDS:
                yield i, " ".join(w), w


def band_keys(texts: list[str | list[str]], numbers: Numbers) -> tuple[np.ndarray, np.ndarray]:
    """(text, band) keys of paragraphs given as plain words, in one string or a list, and the number of distinct shingles of each."""
    out, distinct = np.empty((len(texts), BANDS), np.int64), np.empty(len(texts), np.int32)
    hashed = [np.fromiter(map(numbers.__getitem__, t.split(" ") if isinstance(t, str) else t), np.uint64) for t in texts]
    at = 0
    while at < len(hashed):
        end, size = at, 0
        while end < len(hashed) and (end == at or size + len(hashed[end]) <= CHUNK):
            size += len(hashed[end])
            end += 1
        flat = np.concatenate(hashed[at:end])
        n = np.array([len(h) for h in hashed[at:end]])
        x = np.zeros(len(flat) - SHINGLE + 1, np.uint64)
        for k in range(SHINGLE):
            x += flat[k:len(flat) - SHINGLE + 1 + k] * _WEIGH[k]
        x ^= x >> np.uint64(29)
        # shingles across two paragraphs are the last four of each but the last
        ends = np.cumsum(n)
        keep = np.ones(len(x), bool)
        for k in range(1, SHINGLE):
            keep[ends[:-1] - k] = False
        x = x[keep]
        first = np.concatenate([[0], np.cumsum(n - SHINGLE + 1)[:-1]])
        distinct[at:end] = [len({*part.tolist()}) for part in np.split(x, first[1:])]
        key = np.zeros((end - at, BANDS), np.uint64)
        y, high = np.empty_like(x), np.empty_like(x)
        for j in range(BANDS * ROWS):
            np.multiply(x, _MUL[j], out=y)
            y += _ADD[j]
            y ^= np.right_shift(y, np.uint64(32), out=high)
            y *= np.uint64(0x9E3779B97F4A7C15)
            least = np.minimum.reduceat(y, first)
            key[:, j // ROWS] = (key[:, j // ROWS] ^ least) * np.uint64(0xC2B2AE3D27D4EB4F)
        out[at:end] = (key ^ key >> np.uint64(31)).view(np.int64)
        at = end
    return out, distinct


def shingles(words: str) -> set[tuple]:
    w = words.split(" ")
    return {*zip(*(w[k:] for k in range(SHINGLE)))}


def jaccard(a: set, b: set) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def named(docs: DataFrame) -> DataFrame:
    """(doc_id, at, text): `at` is a hash of the text."""
    d = docs.toDF(*[f"_{i}" for i in range(len(docs.columns))])
    id_, text = (F.col(f"_{docs.columns.index(n)}") for n in ("doc_id", "text"))
    return d.select(id_.cast("bigint").alias("doc_id"), F.xxhash64(text).alias("at"), text.alias("text"))


def _listed(docs: DataFrame) -> DataFrame:
    """(doc_id, at, place, n_words, class, made): every paragraph with the digest of its words, and the
    band keys of its class where a task meets the class first, else null; they depend on the words alone."""
    def run(batches):
        words, numbers, seen = Words(), Numbers(), set()
        for b in batches:
            out, texts = ([], [], [], [], []), []
            for i, text in enumerate(strings(b, "text")):
                for p, line, w in paragraphs(text or "", words):
                    d, first = digest(line), None
                    if d not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(d)
                        first = len(texts)
                        texts.append(w)
                    for col, v in zip(out, (i, p, len(w), d, first)):
                        col.append(v)
            at = pa.array(out[0], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()),
                                              pa.array(out[3], pa.int64()), _keys(texts, numbers).take(pa.array(out[4], pa.int32()))],
                                             names=["doc_id", "at", "place", "n_words", "class", "made"])

    return arrow_map(named(docs), run, "doc_id bigint, at bigint, place int, n_words int, class bigint, made struct<keys:array<bigint>,distinct:int>")


def only(rows: DataFrame, keys: DataFrame, name: str = "class") -> DataFrame:
    """The rows joined to a table of keys by `name`. Most rows without a key there are not shuffled."""
    held = may_hold(rows.sparkSession, filter_of(keys.select(name), name))
    return rows.where(held(name)).join(keys, name)


def spot(who: Column, place: Column) -> Column:
    """A hash of a line: its document's, changed by its place, as _words() has it too."""
    return who.bitwiseXOR(place.cast("bigint") * F.lit(_SPOT))


def _words(docs: DataFrame, paras: DataFrame, needed: DataFrame) -> DataFrame:
    """(class, words) of the needed classes. One line of each is read again; a filter tells tasks which."""
    line = (only(paras.where("made is not null").select("class", spot(F.xxhash64("doc_id", "at"), F.col("place")).alias("spot")), needed)
            .groupBy("class").agg(F.min("spot").alias("spot")))
    sent = docs.sparkSession.sparkContext.broadcast(filter_of(line, "spot"))

    def run(batches):
        words, bits = Words(), sent.value
        for b in batches:
            classes, texts = [], []
            for who, text in zip(b.column(0).to_pylist(), strings(b, "text")):
                for i, line in enumerate((text or "").split("\n")):
                    at = (who ^ i * _SPOT) % FILTER
                    if bits[at >> 3] >> (at & 7) & 1:
                        for _, w, _ in paragraphs(line, words):
                            classes.append(digest(w))
                            texts.append(w)
            if classes:
                yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array(texts)], names=["class", "words"])

    rows = arrow_map(named(docs).select(F.xxhash64("doc_id", "at").alias("who"), "text"), run, "class bigint, words string")
    return rows.join(needed, "class", "left_semi").groupBy("class").agg(F.first("words").alias("words"))


def _keys(texts: list[list[str]], numbers: Numbers) -> pa.Array:
    keys, distinct = band_keys(texts, numbers)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
    return pa.StructArray.from_arrays([lists, pa.array(distinct)], names=["keys", "distinct"])


def candidates(paras: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b) with a < b, pairs of classes that share a key and whose numbers of distinct shingles allow the
    similarity; and (key, class, distinct) of the crowded keys. A class may come several times with its keys.

    The keys of all classes are shuffled once. Sorted by key and class, a row next to another class of its
    key tells that both share it; no more of a key is looked at together."""
    rows = (paras.select("class", "made.distinct", F.posexplode("made.keys").alias("t", "key"))
            .select("class", F.xxhash64("t", "key").alias("key"), "distinct"))  # the two long hashes side by side: shuffled bytes compress better
    of_key = Window.partitionBy("key").orderBy("class")
    beside = (F.lag("class").over(of_key) != F.col("class")) | (F.lead("class").over(of_key) != F.col("class"))
    rows = stage(rows.withColumn("beside", beside).where("beside").select("key", "class", "distinct").distinct())
    many = known_size(rows.groupBy("key").count().where(F.col("count") > CROWD).select("key"))
    calm = rows.join(many, "key", "left_anti")
    pairs = _sized(calm.alias("x").join(calm.alias("y"), "key").where("x.class < y.class"))
    return pairs.distinct(), rows.join(many, "key", "left_semi")


def _sized(pairs: DataFrame) -> DataFrame:
    low, high = (f(F.col("x.distinct"), F.col("y.distinct")) for f in (F.least, F.greatest))
    return pairs.where(low / high >= THRESHOLD).select(
        F.least("x.class", "y.class").alias("a"), F.greatest("x.class", "y.class").alias("b"))


def links(docs: DataFrame, paras: DataFrame, pairs: DataFrame, crowd: DataFrame) -> DataFrame:
    """The pairs (a, b) whose words have a Jaccard similarity of THRESHOLD or more, and pairs of that
    similarity that join what such pairs join among the classes of each crowded key."""
    needed = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).union(crowd.select("class")).distinct()
    words = stage(_words(docs, paras, stage(needed)))
    both = (pairs.join(words.toDF("a", "x"), "a").join(words.toDF("b", "y"), "b"))

    def run(batches):
        for b in batches:
            yield b.select(["a", "b"]).filter(pa.array([v >= THRESHOLD for v in _likeness(b)], pa.bool_()))

    made = arrow_map(both.select("a", "b", "x", "y"), run, "a bigint, b bigint")
    return made if crowd.isEmpty() else made.unionByName(_crowd_links(crowd, words))


def _likeness(b: pa.RecordBatch) -> list[float]:
    sets: dict[str, set] = {}
    out = []
    for x, y in zip(strings(b, "x"), strings(b, "y")):
        for t in (x, y):
            if t not in sets:
                sets[t] = shingles(t)
        out.append(jaccard(sets[x], sets[y]))
    return out


def forest(texts: list[str], side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs of THRESHOLD or more that join what all such pairs join; with `side`, of pairs of two sides only."""
    number: dict[tuple, int] = {}
    sets = [np.array([number.setdefault(g, len(number)) for g in shingles(t)]) for t in texts]
    sizes = np.array([len(x) for x in sets])
    owner, flat = np.repeat(np.arange(len(texts)), sizes), np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    holders = np.split(owner[order], np.cumsum(np.bincount(flat))[:-1])
    label, out = np.arange(len(texts)), []
    for i, own in enumerate(sets):
        both = np.bincount(np.concatenate([holders[g] for g in own.tolist()]), minlength=len(texts))
        near = (both / (sizes + sizes[i] - both) >= THRESHOLD) & (label != label[i])
        if side is not None:
            near &= side != side[i]
        for j in np.flatnonzero(near).tolist():
            if label[j] != label[i]:
                out.append((i, j))
                label[label == label[j]] = label[i]
    return out


def _crowd_links(crowd: DataFrame, words: DataFrame) -> DataFrame:
    """(a, b): links that join what the links among the classes of a crowded key join. All classes are
    compared with the key's pivot; those linked to it are joined by that. The others are compared with
    one another and with them, in tasks of two blocks of classes. One minus the Jaccard similarity is a metric, so a
    class linked to the pivot is left out if none of the others is near enough to the pivot for a link."""
    pivot = crowd.groupBy("key").agg(F.max_by("class", F.struct("distinct", "class")).alias("b"))
    rows = (crowd.join(known_size(pivot), "key").select("key", F.col("class").alias("a"), "b")
            .join(words.toDF("a", "x"), "a").join(words.toDF("b", "y"), "b").select("key", "a", "b", "x", "y"))

    def measure(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(_likeness(b), pa.float64())], names=["key", "a", "b", "x", "near"])

    rows = stage(arrow_map(rows, measure, "key bigint, a bigint, b bigint, x string, near double"))
    tied = rows.where(F.col("near") >= THRESHOLD)
    others = (rows.where(F.col("near") < THRESHOLD).groupBy("key")
              .agg(F.count("*").alias("others"), F.max("near").alias("nearest")))
    # a tied class t meets another o only if 1 - near(t) >= (1 - near(o)) - (1 - THRESHOLD)
    tied_left = tied.join(known_size(others), "key").where(F.col("near") <= F.col("nearest") + 1 - THRESHOLD + 1e-9)
    size = known_size(others.join(tied_left.groupBy("key").agg(F.count("*").alias("tied")), "key", "left")
                      .select("key", F.ceil(F.col("others") / BLOCK).cast("int").alias("p"),
                              F.ceil(F.coalesce("tied", F.lit(0)) / BLOCK).cast("int").alias("q"), "nearest"))
    # blocks 0 to p-1 are of the others, p to p+q-1 of those tied to the pivot, which only meet others
    placed = (rows.join(size, "key").where(F.col("near") <= F.col("nearest") + 1 - THRESHOLD + 1e-9)
              .withColumn("block", F.when(F.col("near") < THRESHOLD, F.pmod(F.xxhash64("a"), "p"))
                          .otherwise(F.col("p") + F.pmod(F.xxhash64("a"), F.greatest("q", F.lit(1)))).cast("int"))
              .withColumn("other", F.explode(F.when(F.col("block") < F.col("p"), F.sequence(F.lit(0), F.col("p") + F.col("q") - 1))
                                             .otherwise(F.sequence(F.lit(0), F.col("p") - 1))))
              .select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "a", "x"))

    def join(table: pa.Table) -> pa.Table:
        names, side = table.column("a").to_pylist(), table.column("block").to_numpy()
        two = side if table.column("i")[0] != table.column("j")[0] else None
        made = forest(table.column("x").to_pylist(), two)
        return pa.table({"a": pa.array([names[i] for i, _ in made], pa.int64()), "b": pa.array([names[j] for _, j in made], pa.int64())})

    return (tied.where("a <> b").select("a", "b")
            .unionByName(placed.groupBy("key", "i", "j").applyInArrow(join, "a bigint, b bigint")))


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, at, place, n_words, cluster, kept, keeper): each paragraph of docs (doc_id, text) that
    has a near copy, its line number, its cluster, whether it stays, and the document whose stays.

    Of all paragraphs only a spot is summed for each class; those whose class has another spot or a link go on."""
    paras = stage(_listed(docs))
    pairs, crowd = map(stage, candidates(paras))
    comps = components(links(docs, paras, pairs, crowd)).select(F.col("node").alias("class"), "component")
    at = paras.select("class", spot(F.xxhash64("doc_id", "at"), F.col("place")).alias("spot"))
    classes = (at.groupBy("class").agg(F.min("spot").alias("low"), F.max("spot").alias("high")).join(comps, "class", "left")
               .where("component is not null or low <> high").select("class", F.coalesce("component", "class").alias("cluster")))
    found = stage(only(paras.drop("made"), known_size(classes)).drop("class"))
    who = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "at", "place")
    firsts = known_size(found.groupBy("cluster").agg(F.min(who).alias("first")))
    # a document that comes in several rows is one
    return found.join(firsts, "cluster").select("doc_id", "at", "place", "n_words", "cluster", who.eqNullSafe(F.col("first")).alias("kept"),
                                                F.col("first.doc_id").alias("keeper")).distinct()


def with_passages(docs: DataFrame) -> DataFrame:
    """The rows of repeats() and, with their first and last character (begin, end), the passages that stand
    elsewhere in lines or across them; passages are looked for in what the repeats leave."""
    found = stage(repeats(docs))
    return found.withColumns({"begin": F.lit(None).cast("bigint"), "end": F.lit(None).cast("bigint")}).unionByName(_passages(docs, _gone(found)))


def _gone(found: DataFrame) -> DataFrame:
    return known_size(found.where("not kept").groupBy(F.col("doc_id").alias("id"), F.col("at").alias("_at"))
                      .agg(F.collect_list("place").alias("gone")))


def _passages(docs: DataFrame, gone: DataFrame) -> DataFrame:
    from .passages import passages

    docs = named(docs)
    bits = filter_of(gone.select(F.xxhash64("id", "_at").alias("who")), "who")
    # only the documents that may have lines to leave out are shuffled to them
    some = docs.where(may_hold(docs.sparkSession, bits)(F.xxhash64("doc_id", "at")))
    joined = some.join(gone, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("_at") == F.col("at")), "left")
    return passages(docs, stage(joined.select("doc_id", "at", "text", "gone")), bits)


def remainder(text: str, gone, begins, ends) -> str:
    """The text without the lines `gone` and the characters from each begin to its end, which ascend. Lines
    that this leaves blank go; other line breaks stay."""
    out, lost, at, k = [], {*gone}, 0, 0
    for i, line in enumerate(text.split("\n")):
        end, left, cut = at + len(line), [], False
        begin = at
        while k < len(begins) and begins[k] < end:
            if ends[k] > at:
                left.append(text[begin:max(begin, begins[k])])
                begin, cut = max(begin, min(ends[k], end)), True
            if ends[k] > end:
                break
            k += 1
        left = "".join(left) + text[begin:end]
        if i not in lost and (left.strip() or not cut):
            out.append(left)
        at = end + 1
    return "\n".join(out)


def _remainders(text: pd.Series, gone: pd.Series, begins: pd.Series, ends: pd.Series) -> pd.Series:
    return pd.Series([t if g is None or t is None else remainder(t, g, b, e) for t, g, b, e in zip(text, gone, begins, ends)], dtype=object)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with the paragraphs and passages removed that repeat one kept elsewhere; a column n_chars follows the text."""
    found = with_passages(docs).where("not kept")
    span = F.when(F.col("begin").isNotNull(), F.struct("begin", "end"))
    gone = (found.groupBy(F.col("doc_id").alias("id"), "at")
            .agg(F.collect_list(F.when(F.col("begin").isNull(), F.col("place"))).alias("gone"), F.sort_array(F.collect_list(span)).alias("spans")))
    d = docs.toDF(*[f"_{i}" for i in range(len(docs.columns))])
    id_, text = (F.col(f"_{docs.columns.index(n)}") for n in ("doc_id", "text"))
    gone = known_size(gone.select("id", "at", "gone", F.col("spans.begin").alias("begins"), F.col("spans.end").alias("ends")))
    # documents that keep all their text are not shuffled, but for the few that the filter can't tell
    some = may_hold(docs.sparkSession, filter_of(gone.select(F.xxhash64("id", "at").alias("who")), "who"))
    d = d.withColumn("some", some(F.xxhash64(id_.cast("bigint"), F.xxhash64(text))))
    joined = d.where("some").join(gone, F.col("id").eqNullSafe(id_.cast("bigint")) & (F.col("at") == F.xxhash64(text)), "left")
    joined = (joined.withColumn("left", F.pandas_udf(_remainders, "string")(text, "gone", "begins", "ends")).drop("begins", "ends")
              .unionByName(d.where("not some"), allowMissingColumns=True))
    new = F.when(F.col("gone").isNotNull(), F.col("left")).otherwise(text)
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    return joined.select(*[(new if n == "text" and i == docs.columns.index("text") else
                            F.when(F.col("gone").isNotNull(), F.char_length("left")).otherwise(F.col(f"_{i}")).cast(docs.schema[i].dataType)
                            if i == size else F.col(f"_{i}")).alias(n) for i, n in enumerate(docs.columns)])
