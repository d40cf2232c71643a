"""Passages that repeat in another document, wherever they stand in their lines.

A passage is a run of at least PASSAGE words that another document has too, compared as paragraphs are,
by lower-cased words without the signs at their ends; line breaks do not count. Scripts that set no space
between words count every character as a word, and tokens of over LONG characters are cut after certain
characters. Near copies are found as far as they share such runs.

Of every window of PASSAGE words the least hash of its runs of ANCHOR words is its anchor, so equal
windows have equal anchors and neighbours mostly share one. Documents are first dealt by anchors; only
windows whose anchor two documents hold are then compared, by a hash of all their words. Nothing is
paired and no group is capped: the first document of a window, by doc_id (nulls last) and text hash,
keeps it, and in all others its words are repeated. What is repeated inside a single document stays.
"""
from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import known_size, stage
from .common import arrow_map, filter_of, in_filter, may_hold, strings
from .paragraph_bands import MEMO, only, plain, word_hash

PASSAGE, ANCHOR, LONG = 50, 20, 64
#: Words hashed at once, but for longer texts.
CHUNK = 1 << 17
#: Thai, Lao, Tibetan, Myanmar, Khmer, kana and Han.
_OPEN = "฀-࿿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff"
_UNSPACED, _TOKEN = re.compile(f"[{_OPEN}]"), re.compile(rf"[{_OPEN}]|[^\s{_OPEN}]+")
_SPACED = re.compile(r"\S+")
_PIECE = re.compile(r"[^aeiouAEIOU02468]*[aeiouAEIOU02468]|[^aeiouAEIOU02468]+")
_BASE = np.uint64(0x9E3779B97F4A7C13)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))


class Hashes(dict):
    """token -> hash of its plain word, 0 if it has none; emptied when full."""

    long = False

    def __missing__(self, token: str) -> int:
        if len(token) > LONG:
            self.long = True
            return 0
        w = plain(token)
        h = word_hash(w) or 1 if w else 0
        if len(self) >= MEMO:
            self.clear()
        self[token] = h
        return h

    def of(self, text: str) -> np.ndarray:
        """The hashes of the words of a text."""
        if not text.isascii() and _UNSPACED.search(text):
            text = _UNSPACED.sub(r" \g<0> ", text)
        tokens, self.long = text.split(), False
        out = np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))
        if self.long:
            tokens = [p for t in tokens for p in (_PIECE.findall(t) if len(t) > LONG else (t,))]
            out = np.fromiter(map(self.__getitem__, (t[:LONG] for t in tokens)), np.uint64, len(tokens))
        return out[out > 0]

    def places(self, text: str) -> np.ndarray:
        """(word, 2): where the same words begin and end."""
        if text.isascii() or not _UNSPACED.search(text):
            tokens, self.long = text.split(), False
            kept = np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens)) > 0
            if not self.long:
                begin = np.fromiter((m.start() for m in _SPACED.finditer(text)), np.int64, len(tokens))
                return np.stack([begin, begin + np.fromiter(map(len, tokens), np.int64, len(tokens))], 1)[kept]
        out = []
        for m in _TOKEN.finditer(text):
            for p in _PIECE.finditer(m[0]) if len(m[0]) > LONG else (None,):
                begin, end = (p.start(), p.end()) if p else (0, len(m[0]))
                if self[m[0][begin:end][:LONG]]:
                    out.append((m.start() + begin, m.start() + end))
        return np.array(out, np.int64).reshape(-1, 2)


def _runs(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    power, back = np.full(len(h), _BASE, np.uint64), np.full(len(h), _BACK, np.uint64)
    power[0] = back[0] = 1
    power, back = np.cumprod(power, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power)])
    out = (total[n:] - total[:-n]) * back[:len(h) - n + 1]
    out = (out ^ out >> np.uint64(29)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return out ^ out >> np.uint64(32)


def windows(hashed: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, hash, anchor) of every window of PASSAGE words."""
    sizes = np.array([len(h) for h in hashed], np.int64)
    if sizes.sum() < PASSAGE:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    flat = np.concatenate(hashed)
    owner, start = np.repeat(np.arange(len(hashed)), sizes), np.cumsum(sizes) - sizes
    least, width, want = _runs(flat, ANCHOR), 1, PASSAGE - ANCHOR + 1
    while width < want:
        step = min(width, want - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    whole = np.flatnonzero(owner[:len(flat) - PASSAGE + 1] == owner[PASSAGE - 1:])
    return owner[whole], whole - start[owner[whole]], _runs(flat, PASSAGE)[whole], least[whole]


def _chunks(batches, hashes: Hashes, cut: bytes):
    """(batch, rows, windows of these rows): at most CHUNK words at once, or one text. Rows that are not `ready`
    and that the filter `cut` may hold come again with the lines they lost."""
    for b in batches:
        b = b.filter(pc.or_(b["ready"], pa.array(~in_filter(cut, b["who"].to_numpy()))))
        rows, held, size = [], [], 0
        for i, (text, gone) in enumerate(zip(strings(b, "text"), strings(b, "gone"))):
            h = hashes.of(_left(text, gone))
            if len(h) >= PASSAGE:
                rows.append(i)
                held.append(h)
                size += len(h)
            if size >= CHUNK:
                yield b, np.array(rows), windows(held)
                rows, held, size = [], [], 0
        if held:
            yield b, np.array(rows), windows(held)


def _left(text: str | None, gone: list[int] | None) -> str:
    if not text or not gone:
        return text or ""
    out = {*gone}
    return "\n".join(" " * len(line) if i in out else line for i, line in enumerate(text.split("\n")))


def passages(docs: DataFrame, cut: DataFrame, bits: bytes) -> DataFrame:
    """(doc_id, at, place, n_words, cluster, kept, keeper, begin, end): every passage of docs (doc_id, at,
    text) that another document has: its line, its words, a hash of its first PASSAGE words,
    whether it stays, the document whose stays, and its first and last character. `cut` has those documents
    again whose hash may be in the filter `bits`, with a column `gone`: lines in it, an array of places or null,
    are not read."""
    docs = (cut.withColumn("ready", F.lit(True))
            .unionByName(docs.withColumns({"gone": F.lit(None).cast("array<int>"), "ready": F.lit(False)}))
            .withColumn("who", F.xxhash64("doc_id", "at")))
    lost = docs.sparkSession.sparkContext.broadcast(bits)

    def anchors(batches):
        hashes = Hashes()
        for b, rows, (text, _, _, anchor) in _chunks(batches, hashes, lost.value):
            new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])[:len(anchor)])
            at = pa.array(rows[text[new]], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(anchor[new].view(np.int64)), b.column(2).take(at)], names=["class", "who"])

    shared = (arrow_map(docs.select("text", "gone", "who", "ready"), anchors, "class bigint, who bigint").groupBy("class")
              .agg(F.min("who").alias("low"), F.max("who").alias("high")).where("low <> high").select("class"))
    sent = docs.sparkSession.sparkContext.broadcast(filter_of(shared, "class"))

    def held(batches):
        hashes = Hashes()
        for b, rows, (text, word, window, anchor) in _chunks(batches, hashes, lost.value):
            here = np.flatnonzero(in_filter(sent.value, anchor.view(np.int64)))
            at = pa.array(rows[text[here]], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(2).take(at), b.column(3).take(at), pa.array(word[here].astype(np.int32)),
                                              pa.array(window[here].view(np.int64))], names=["doc_id", "at", "word", "window"])

    listed = stage(arrow_map(docs.select("text", "gone", "doc_id", "at", "who", "ready"), held, "doc_id bigint, at bigint, word int, window bigint"))
    who = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "at")
    twice = known_size(listed.groupBy("window").agg(F.min(who).alias("first"), F.max(who).alias("last")).where("first <> last")
                       .select("window", "first"))
    each = (only(listed, twice, "window")
            .groupBy("doc_id", "at").agg(F.sort_array(F.collect_set(F.struct(
                "word", "window", who.eqNullSafe(F.col("first")).alias("kept"), F.col("first.doc_id").alias("keeper")))).alias("held")))
    each = known_size(each.select(F.col("doc_id").alias("id"), F.col("at").alias("_at"), "held"))
    # as before, only the documents that may be in `each` are shuffled
    spark, who = docs.sparkSession, F.col("who")
    found = may_hold(spark, filter_of(each.select(F.xxhash64("id", "_at").alias("who")), "who"))
    some = docs.where(found(who)).where(F.col("ready") | ~may_hold(spark, bits)(who))
    met = some.join(each, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("_at") == F.col("at"))).select("doc_id", "at", "text", "gone", "held")

    def spans(batches):
        hashes = Hashes()
        for b in batches:
            out = []
            lists = b["held"]
            flat, ends = lists.flatten(), np.cumsum(pc.list_value_length(lists).to_numpy())
            words, keeps = flat.field("word").to_numpy(), flat.field("kept").to_numpy(zero_copy_only=False)
            for i, (text, gone, end) in enumerate(zip(strings(b, "text"), strings(b, "gone"), ends.tolist())):
                places = hashes.places(_left(text, gone))
                state, by = np.zeros(len(places), np.int8), np.full(len(places), -1)
                here = np.arange(ends[i - 1] if i else 0, end)
                for kept in (True, False):  # a word of both is repeated
                    of = here[keeps[here] == kept]
                    if len(of):
                        # the first window over each word; windows ascend by their first word
                        at = np.arange(len(places))
                        k = of[np.minimum(np.searchsorted(words[of], at - PASSAGE + 1), len(of) - 1)]
                        over = (words[k] <= at) & (words[k] > at - PASSAGE)
                        by[over], state[over] = k[over], 2 - kept
                edge = np.flatnonzero(np.diff(np.concatenate([[0], state, [0]]).astype(int)))
                for first, end in zip(edge[:-1].tolist(), edge[1:].tolist()):
                    if state[first]:
                        begin, stop, x = int(places[first, 0]), int(places[end - 1, 1]), flat[int(by[first])].as_py()
                        out.append((i, text.count("\n", 0, begin), end - first, x["window"], bool(state[first] == 1), x["keeper"], begin, stop))
            cols = list(zip(*out)) or [()] * 8
            at = pa.array(cols[0], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()),
                                              pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.bool_()), *(pa.array(c, pa.int64()) for c in cols[5:])],
                                             names=["doc_id", "at", "place", "n_words", "cluster", "kept", "keeper", "begin", "end"])

    return arrow_map(met, spans, "doc_id bigint, at bigint, place int, n_words int, cluster bigint, kept boolean, keeper bigint, begin bigint, end bigint").distinct()
