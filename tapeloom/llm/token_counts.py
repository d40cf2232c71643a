"""Token counts by distinct pre-token.

Pieces are counted once for each distinct pre-token of the corpus, then joined to the pre-token
frequencies of each document and summed; no id is ever made. The most frequent pre-tokens, whose
number is a parameter, travel with the tasks and are summed before the shuffle, because each of
them is a join key that a large part of all documents has. Only rows of rarer pre-tokens are
shuffled and joined.

Null text counts as empty text: 0 bytes, 0 tokens. Each input row gives one row, also when rows
repeat. An empty table gives an empty result.
"""
from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import arrow_map, batch_of, pick, strings, take
from .pretokens import Cutter, Memo, pretoken_counts, tokenizer

#: Pre-tokens that travel with the tasks, and the longest of them: at most 8 MB of text.
HOT, HOT_CHARS = 1 << 17, 64


def pieces_of(vocabulary: DataFrame, path: str) -> DataFrame:
    """(pretoken, n) with `pieces`, the number of tokens of the pre-token."""
    schema = pa.schema([("pretoken", pa.string()), ("n", pa.int64()), ("pieces", pa.int32())])

    def count(batches):
        tok = tokenizer(path)
        for b in batches:
            words = strings(b, "pretoken")
            made = tok.encode_batch_fast(words, add_special_tokens=False)
            yield batch_of(schema, words, b.column(1), [len(e.ids) for e in made])

    return arrow_map(vocabulary, count, "pretoken string, n bigint, pieces int")


def token_counts(docs: DataFrame, path: str, limit: int, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of docs (doc_id, text)."""
    docs = pick(docs, "doc_id", "text")
    spark = docs.sparkSession
    vocabulary = stage(pieces_of(pretoken_counts(docs, path), path))
    top = (vocabulary.where(F.length("pretoken") <= HOT_CHARS)
           .orderBy(F.desc("n"), "pretoken").limit(hot).select("pretoken", "pieces").collect())
    known = spark.sparkContext.broadcast({r[0]: r[1] for r in top})
    schema = pa.schema([("row", pa.int64()), ("key", pa.string()), ("doc_id", docs_type(docs)), ("n_bytes", pa.int64()),
                        ("freq", pa.int64())])

    def frequencies(batches):
        cut, pieces = Cutter(path), known.value
        at = TaskContext.get().partitionId() << 40

        def split(piece):
            """Tokens of the known pre-tokens of a piece, and the other pre-tokens."""
            words = cut(piece)
            rest = tuple(w for w in words if w not in pieces)
            n = sum(pieces.get(w, 0) for w in words)
            return (n, rest) if rest else n

        memo = Memo(split)

        def rows():
            nonlocal at
            for b in batches:
                for doc, text in zip(strings(b, "doc_id"), strings(b, "text")):
                    at, text, n, rare = at + 1, text or "", 0, []
                    for v in memo.of(text):
                        if type(v) is int:
                            n += v
                        else:
                            n += v[0]
                            rare += v[1]
                    # a key of its own keeps the rows of the documents themselves from meeting in one task
                    yield at, f"\0{at}", doc, len(text.encode()), n
                    for w, f in Counter(rare).items():
                        yield at, w, None, None, f

        for part in take(rows(), 50_000):
            yield batch_of(schema, *zip(*part))

    doc_type = docs.schema["doc_id"].dataType.simpleString()
    rows = arrow_map(docs, frequencies, f"row bigint, key string, doc_id {doc_type}, n_bytes bigint, freq bigint")
    summed = (rows.join(vocabulary.select(F.col("pretoken").alias("key"), "pieces"), "key", "left")
              .groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"),
                                  F.sum(F.col("freq") * F.coalesce("pieces", F.lit(1))).alias("n_tokens")))
    return summed.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def docs_type(docs: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(docs.schema["doc_id"].dataType)
