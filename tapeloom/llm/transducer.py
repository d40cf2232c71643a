"""BPE encoding and decoding with a transducer lexicon.

The words of the tokenizer's vocabulary, which are the most frequent ones of the texts it was trained
on, are compiled into a minimal acyclic automaton, the same for all tables (no text is counted): states that have the same future are one state. Each edge holds the
number of words that sort before those behind it, so the sum along a word's path is the word's
rank, and the rank is the place of its ids. The automaton is a flat file that Spark gives to every
executor and that its workers map into memory, so they share its pages. Words it does not hold are
merged by the tokenizers library; the automaton's ids come from the same ranked merges, so every word
gets the same ids either way.

Null text counts as empty text and has no ids; repeated rows give repeated results; an empty table
gives an empty result. A piece of text without spaces may be as long as the text.
"""
from __future__ import annotations

import heapq
import struct
import uuid
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from ..session import shared_dir
from .common import arrow_map, batch_of, list_array, pick, strings
from .pretokens import KEPT_CHARS, Cutter, Memo, spec, tokenizer

#: Words of the lexicon at most.
LEXICON = 1 << 17
#: Pieces that a task keeps, and characters of texts that are encoded together.
HELD, SLICE = 1 << 19, 1 << 22


# --- exact merges -------------------------------------------------------------------------------

@lru_cache(maxsize=1)
def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte: printable bytes stand
    for themselves, the others are numbered from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Merger:
    """Ids of a pre-token by ranked merges."""

    def __init__(self, path: str):
        s = spec(path)
        model = s["model"]
        if model.get("ignore_merges") or model.get("dropout") or model.get("unk_token"):
            raise ValueError(f"{path}: merges are not plain")
        self.ids = model["vocab"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.rank = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.special = {a["content"]: a["id"] for a in s["added_tokens"]}
        self.letters = byte_letters()

    def __call__(self, word: str) -> list[int]:
        if word in self.special:
            return [self.special[word]]
        parts = [self.letters[b] for b in word.encode()]
        parts = self.short(parts) if len(parts) <= 24 else self.long(parts)
        return [self.ids[p] for p in parts]

    def short(self, parts: list[str]) -> list[str]:
        rank, none = self.rank.get, len(self.rank)
        while len(parts) > 1:
            ranks = [rank(p, none) for p in zip(parts, parts[1:])]
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def long(self, parts: list[str]) -> list[str]:
        """The same with a heap over linked parts."""
        n, rank = len(parts), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, p) for i, p in enumerate(zip(parts, parts[1:])) if (r := rank.get(p)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, (a, b) = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0 and y < n and (r := rank.get((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (r, x, (parts[x], parts[y])))
        return [p for p in parts if p is not None]


# --- the automaton ------------------------------------------------------------------------------

def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """The automaton of the given words as one block of bytes. Words are added in order; when a
    word leaves a branch, the states of that branch are final and are merged with equal ones."""
    words = sorted(entries)
    edges: list[dict[int, int]] = [{}]
    ends: list[bool] = [False]
    known: dict[tuple, int] = {}

    def settle(path: list[int], word: bytes, depth: int) -> None:
        for i in range(len(path) - 1, depth, -1):
            s = path[i]
            form = (ends[s], tuple(edges[s].items()))
            if (same := known.setdefault(form, s)) != s:
                edges[path[i - 1]][word[i - 1]] = same
                spare.append(s)

    path, last, spare = [0], b"", []
    for w in words:
        shared = 0
        while shared < min(len(w), len(last)) and w[shared] == last[shared]:
            shared += 1
        settle(path, last, shared)
        del path[shared + 1:]
        for b in w[shared:]:
            if spare:
                s = spare.pop()
                edges[s], ends[s] = {}, False
            else:
                s = len(edges)
                edges.append({})
                ends.append(False)
            edges[path[-1]][b] = s
            path.append(s)
        ends[path[-1]] = True
        last = w
    settle(path, last, 0)

    order, place, todo = [], {0: 0}, [0]
    while todo:
        s = todo.pop()
        order.append(s)
        for t in edges[s].values():
            if t not in place:
                place[t] = 0
                todo.append(t)
    place = {s: i for i, s in enumerate(order)}
    behind: dict[int, int] = {}
    for root in (0,):
        stack = [(root, False)]
        while stack:
            s, done = stack.pop()
            if s in behind:
                continue
            if done:
                behind[s] = ends[s] + sum(behind[t] for t in edges[s].values())
            else:
                stack.append((s, True))
                stack += [(t, False) for t in edges[s].values() if t not in behind]
    key, target, skip = [], [], []
    for s in order:
        n = int(ends[s])
        for b, t in edges[s].items():
            key.append(place[s] << 8 | b)
            target.append(place[t])
            skip.append(n)
            n += behind[t]
    ids = [entries[w] for w in words]
    arrays = [np.array(key, np.int64), np.array(target, np.int32), np.array(skip, np.int32),
              np.array([ends[s] for s in order], np.uint8),
              np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32),
              np.array([i for x in ids for i in x], np.int32)]
    head = struct.pack("<6q", *(len(a) for a in arrays))
    return head + b"".join(a.tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays)


class Lexicon:
    """The automaton, mapped from its file."""

    def __init__(self, path: str):
        sizes = struct.unpack("<6q", open(path, "rb").read(48))
        at, arrays = 48, []
        for n, kind in zip(sizes, (np.int64, np.int32, np.int32, np.uint8, np.int32, np.int32)):
            arrays.append(np.memmap(path, kind, "r", at, n) if n else np.empty(0, kind))
            at += n * kind().nbytes + -n * kind().nbytes % 8
        self.key, self.target, self.skip, self.end, self.offset, self.ids = arrays

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """Place of each word, -1 where the lexicon has it not; all words walk side by side."""
        n = len(words)
        length = np.fromiter(map(len, words), np.int64, n)
        starts = np.concatenate([[0], np.cumsum(length)[:-1]]) if n else length
        flat = np.frombuffer(b"".join(words), np.uint8)
        state, rank = np.zeros(n, np.int64), np.zeros(n, np.int64)
        live = np.flatnonzero(length > 0) if len(self.key) else np.empty(0, np.int64)
        state[length == 0] = -1
        if not len(self.key):
            state[:] = -1
        step = 0
        while len(live):
            k = state[live] << 8 | flat[starts[live] + step]
            e = np.minimum(np.searchsorted(self.key, k), len(self.key) - 1)
            hit = self.key[e] == k
            state[live] = np.where(hit, self.target[e], -1)
            rank[live] += self.skip[e]
            step += 1
            live = live[hit & (length[live] > step)]
        ok = state >= 0
        ok[ok] = self.end[state[ok]] == 1
        return np.where(ok, rank, -1)

    def of(self, rank: int) -> np.ndarray:
        return self.ids[self.offset[rank]:self.offset[rank + 1]]


@lru_cache(maxsize=2)
def lexicon(name: str) -> Lexicon:
    return Lexicon(SparkFiles.get(name))


@lru_cache(maxsize=2)
def merger(path: str) -> Merger:
    return Merger(path)


def share(spark: SparkSession, block: bytes) -> str:
    """Write the automaton to the shared folder and let Spark hand it to the executors, also to
    those that start later; returns the file's name there."""
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(block))
    out.close()
    spark.sparkContext.addFile(path.toString())
    return name


def vocabulary_words(path: str) -> list[str]:
    """The tokens that are texts by themselves, in the order of their merges. Tokens that hold a part of a
    character only are left out: no pre-token is one."""
    byte = {c: b for b, c in enumerate(byte_letters())}
    out = []
    for token, _ in sorted(spec(path)["model"]["vocab"].items(), key=lambda item: item[1]):
        try:
            out.append(bytes(byte[c] for c in token).decode())
        except (KeyError, UnicodeDecodeError):
            pass
    return out


def build_lexicon(spark: SparkSession, path: str, words: int = LEXICON) -> str:
    """Compile the vocabulary's first `words` words with the ids that the merges give them, and return the name
    of the shared file. Which words it holds changes how fast others are merged, never their ids."""
    merge = merger(path)
    return share(spark, compile_lexicon({w.encode(): merge(w) for w in vocabulary_words(path)[:words]}))


class Encoder:
    """Ids of texts as bytes of int32, from a lexicon and, for the words it has not, from the merges of
    the library. A task keeps the pieces it has met in a bounded memo, and drops them at its end: a reused worker
    would hold them while other stages run."""

    def __init__(self, path: str, name: str):
        self.cut, self.lex, self.tok = Cutter(path), lexicon(name), tokenizer(path)
        self.memo = Memo(lambda piece: self.of_pieces([piece])[0], HELD)

    def of_words(self, words: list[str]) -> dict[str, bytes]:
        out, unseen = {}, []
        for w, r in zip(words, self.lex.ranks([w.encode() for w in words]).tolist()):
            if r >= 0:
                out[w] = self.lex.of(r).tobytes()
            else:
                unseen.append(w)
        for w, e in zip(unseen, self.tok.encode_batch_fast(unseen, add_special_tokens=False)):
            out[w] = np.array(e.ids, np.int32).tobytes()
        return out

    def of_pieces(self, pieces: list[str]) -> list[bytes]:
        found = [self.cut(p) for p in pieces]
        ids = self.of_words([*{*chain.from_iterable(found)}])
        return [ids[ws[0]] if len(ws) == 1 else b"".join([ids[w] for w in ws]) for ws in found]

    def __call__(self, texts: list[str]) -> list[bytes]:
        out, some, size = [], [], 0
        for t in texts:
            some.append(t)
            size += len(t)
            if size >= SLICE:
                out += self.of_texts(some)
                some, size = [], 0
        return out + self.of_texts(some) if some else out

    def of_texts(self, texts: list[str]) -> list[bytes]:
        # the pieces that are new to this worker are looked up together; while these texts are encoded the
        # memo holds all of theirs, whatever their number
        seen = set(chain.from_iterable(t.split(" ")[1:] for t in texts))
        plain = [p for p in seen if len(p) <= KEPT_CHARS and p and not (p[0].isspace() or p[-1].isspace())]
        new = [p for p in plain if p not in self.memo]
        if len(self.memo) + len(new) > HELD:
            self.memo.clear()
            new = plain
        self.memo.limit = HELD + len(seen) + 1
        for lo in range(0, len(new), 1 << 15):
            some = new[lo:lo + (1 << 15)]
            self.memo.update(zip(some, self.of_pieces([" " + p for p in some])))
        return [b"".join(self.memo.of(t)) if t else b"" for t in texts]


@lru_cache(maxsize=1)
def encoder(path: str, name: str) -> Encoder:
    return Encoder(path, name)


# --- the operators ------------------------------------------------------------------------------

def encode(docs: DataFrame, path: str, name: str, *keep: str) -> DataFrame:
    """`keep` columns of docs and `ids` array<int>, the tokens of its text."""
    docs = pick(docs, *keep, "text")
    return arrow_map(docs, _encoding(path, name, keep), f"{_kinds(docs.select(*keep))}, ids array<int>")


def _kinds(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _encoding(path: str, name: str, keep: tuple[str, ...]):
    """Batches of (keep, text) to (keep, ids)."""
    def run(batches):
        enc = encoder(path, name)
        try:
            for b in batches:
                made = enc([t or "" for t in strings(b, "text")])
                ids = list_array(pa.array(np.frombuffer(b"".join(made), np.int32)), [len(m) // 4 for m in made])
                yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(keep))] + [ids], names=[*keep, "ids"])
        finally:
            enc.memo.clear()

    return run


def decode(encoded: DataFrame, path: str, *keep: str) -> DataFrame:
    """`keep` columns and `text`, decoded from `ids`; bytes that are no UTF-8 become U+FFFD, null
    ids an empty text."""
    run = _decoding(encoded.sparkSession, path, keep, len(keep))
    return arrow_map(pick(encoded, *keep, "ids").toDF(*keep, "_ids"), run, f"{_kinds(pick(encoded, *keep))}, text string")


def _decoding(spark: SparkSession, path: str, keep: tuple[str, ...], at: int):
    """Batches that begin with `keep` and have the ids in column `at` to (keep, text)."""
    s = spec(path)
    byte = {c: b for b, c in enumerate(byte_letters())}
    table = {i: bytes(byte[c] for c in t) for t, i in s["model"]["vocab"].items()}
    table |= {a["id"]: a["content"].encode() for a in s["added_tokens"]}
    sent = spark.sparkContext.broadcast([table.get(i, b"") for i in range(max(table) + 1)])

    def run(batches):
        table = sent.value
        flat = np.frombuffer(b"".join(table), np.uint8)
        length = np.array([len(t) for t in table])
        start = np.concatenate([[0], np.cumsum(length)[:-1]])
        for b in batches:
            col = b.column(at)
            ids, data = col.flatten().to_numpy(), []
            for lo in range(0, len(ids), 1 << 16):
                # the bytes of some tokens at once: each token's place in the table, and the places after it
                part = ids[lo:lo + (1 << 16)]
                n = length[part]
                to = np.cumsum(n)
                data.append(flat[np.repeat(start[part] - (to - n), n) + np.arange(to[-1])].tobytes())
            data = b"".join(data)
            cuts = np.concatenate([[0], np.cumsum(length[ids])])
            ends = cuts[np.cumsum(pc.fill_null(pc.list_value_length(col), 0).to_numpy())].tolist()
            text = [data[a:z].decode("utf-8", "replace") for a, z in zip([0, *ends], ends)]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(keep))] + [pa.array(text, pa.string())],
                                             names=[*keep, "text"])

    return run


def round_trip(docs: DataFrame, path: str, words: int = LEXICON) -> DataFrame:
    """(doc_id, ids, text) with the decoded text, for every row of docs (doc_id, text). A batch is encoded
    and decoded by one worker: two Python steps in a row take two workers for each task."""
    docs = pick(docs, "doc_id", "text")
    name = build_lexicon(docs.sparkSession, path, words)
    encoding, decoding = _encoding(path, name, ("doc_id",)), _decoding(docs.sparkSession, path, ("doc_id", "ids"), 1)
    return arrow_map(docs, lambda batches: decoding(encoding(batches)), f"{_kinds(docs.select('doc_id'))}, ids array<int>, text string")
