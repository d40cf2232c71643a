"""Pre-tokens of byte-level BPE tokenizers, cut without running the pattern over every text.

The pattern of these tokenizers never joins the two sides of a single space between two characters
that are not white space: the space opens the next pre-token. A text may therefore be cut at such
spaces, and each cut piece has the same pre-tokens wherever it stands. Pieces repeat, so the
library's own pre-tokenizer runs once for each distinct piece that a worker meets.
"""
from __future__ import annotations

import json
import os
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch_of, pick, strings

SEAM = re.compile(r"(?<=\S) (?=\S)")
#: Entries of a worker's memo and of a task's counter; either is emptied when it is full.
MEMO, COUNTER = 1 << 19, 1 << 19
MARKS = frozenset(".,;:!?")
#: Longer pieces are not kept.
KEPT_CHARS = 64


class Uneven(Exception):
    """White space other than single spaces touches a cut."""


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def spec(path: str) -> dict:
    """The tokenizer's file, if it is of the kind that this module cuts rightly."""
    with open(path, encoding="utf-8") as f:
        s = json.load(f)
    pre = s["pre_tokenizer"] or {}
    plain = all(not (a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"]) and not re.search(r"\s", a["content"])
                for a in s["added_tokens"])
    if s["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex") or not plain:
        raise ValueError(f"{path}: not a plain byte-level tokenizer")
    return s


@lru_cache(maxsize=4)
def specials(path: str) -> list[str]:
    """The added tokens, longest first; the file itself is not kept."""
    return sorted((a["content"] for a in spec.__wrapped__(path)["added_tokens"]), key=len, reverse=True)


class Cutter:
    """Pre-tokens of one piece of text; a special token inside is a pre-token of its own."""

    def __init__(self, path: str):
        self.pre = tokenizer(path).pre_tokenizer
        special = specials(path)
        self.special = set(special)
        self.split = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    def __call__(self, piece: str) -> list[str]:
        # letters after a space, and one mark behind them, are what most pieces are
        if piece[:1] == " ":
            word = piece[1:]
            if word.isalpha():
                return [piece]
            if word[:-1].isalpha() and word[-1] in MARKS:
                return [piece[:-1], piece[-1]]
        parts = self.split.split(piece) if self.split else [piece]
        out = []
        for p in parts:
            if p in self.special:
                out.append(p)
            elif p:
                out += [p[a:b] for _, (a, b) in self.pre.pre_tokenize_str(p)]
        return out


class Memo(dict):
    """piece -> value(piece with the space before it), with a bounded number of entries."""

    def __init__(self, value, limit: int = MEMO):
        super().__init__()
        self.value, self.limit, self.checked = value, limit, True

    def __missing__(self, p: str):
        if self.checked and (not p or p[0].isspace() or p[-1].isspace()):
            raise Uneven
        v = self.value(" " + p)
        if len(p) <= KEPT_CHARS:
            if len(self) >= self.limit:
                self.clear()
            self[p] = v
        return v

    def of(self, text: str) -> list:
        """The values of the pieces of a text, in order."""
        first, *rest = text.split(" ")
        try:
            if rest and (not first or first[-1].isspace()):
                raise Uneven
            return [self.value(first), *map(self.__getitem__, rest)]
        except Uneven:
            first, *rest = SEAM.split(text)
            self.checked = False
            try:
                return [self.value(first), *map(self.__getitem__, rest)]
            finally:
                self.checked = True


def pretoken_counts(docs: DataFrame, path: str) -> DataFrame:
    """(pretoken, n): how often each pre-token occurs in the whole texts. Tasks count pieces before
    anything is shuffled, so the commonest pre-token reaches the shuffle once for each task."""
    schema = pa.schema([("pretoken", pa.string()), ("n", pa.int64())])

    def count(batches):
        cut, heads, pieces = Cutter(path), Counter(), Counter()

        def flush():
            words = Counter()
            for counter, before in ((heads, ""), (pieces, " ")):
                for piece, n in counter.items():
                    for w in cut(before + piece):
                        words[w] += n
                counter.clear()
            return batch_of(schema, list(words), list(words.values()))

        for batch in batches:
            for text in strings(batch, "text"):
                if not text:
                    continue
                first, *rest = text.split(" ")
                new = [p for p in set(rest) if p not in pieces]
                if rest and (not first or first[-1].isspace()) or any(not p or p[0].isspace() or p[-1].isspace() for p in new):
                    first, *rest = SEAM.split(text)
                heads[first] += 1
                pieces.update(rest)
                if len(pieces) + len(heads) >= COUNTER:
                    yield flush()
        yield flush()

    rows = arrow_map(pick(docs, "text"), count, "pretoken string, n bigint")
    return rows.groupBy("pretoken").agg(F.sum("n").alias("n"))
