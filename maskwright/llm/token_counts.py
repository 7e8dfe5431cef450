"""Token counts of whole texts under a public SentencePiece BPE model.

No piece of the model holds a space mark after another character or a line feed, so merges never cross the start of a run
of spaces or a line feed. A text is cut there into pre-tokens. The distinct pre-tokens of all texts are encoded once each;
their numbers of pieces are joined to the documents' pre-token frequencies and summed. Ids are never kept.

The join has two ways, which together are exact. Pre-tokens found most often (MOST_SENT at most, none over LONGEST_SENT
characters) are sent to the executors, where a document's frequencies meet them in the task that reads the text. All
others leave the task as (row, pre-token, frequency) and meet the table of pieces in a shuffled join. Texts aren't shuffled.

Cases: null and empty texts have 0 bytes and 0 tokens; repeated rows count each; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from .common import materialize, small_batches, utf8

#: A run of spaces (the model's mark for them, U+2581, is one too) with what follows it up to the next or a line feed, or a line feed.
PRE_TOKEN = re.compile(r"[ ▁]+[^ ▁\n]*|[^ ▁\n]+|\n")
MOST_HELD = 100_000  # distinct pre-tokens that a task holds before it passes them on
MOST_SENT = 200_000
LONGEST_SENT = 64

REST = pa.list_(pa.struct([("token", pa.string()), ("n", pa.int64())]))

_models: dict[str, object] = {}


def crosses_spaces(pieces: list[str]) -> bool:
    """True if the cut into pre-tokens would be wrong for this vocabulary."""
    return any("\n" in p or "▁" in p.lstrip("▁") for p in pieces)


def _model(path: str):
    if path not in _models:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if crosses_spaces([model.id_to_piece(i) for i in range(model.get_piece_size())]):
            raise ValueError("this model's pieces reach over spaces or line feeds")
        _models[path] = model
    return _models[path]


def pre_tokens(text: str | None) -> list[str]:
    """The pre-tokens of a text, with the space that the model sets in front of it."""
    return PRE_TOKEN.findall(" " + text) if text else []


def pieces_of(path: str, tokens: list[str]) -> list[int]:
    """The number of pieces of each pre-token."""
    model = _model(path)
    # A line feed in front keeps the mark that the model adds away from the pre-token.
    base = len(model.encode("\n"))
    return [len(x) - base for x in model.encode(["\n" + t for t in tokens], num_threads=1)]


def vocabulary(docs: DataFrame, model_path: str) -> DataFrame:
    """(token, n, pieces) of each distinct pre-token of all texts: how often it is found, and its pieces."""

    def gather(batches):
        held: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0):
                held.update(pre_tokens(text.as_py()))
                if len(held) >= MOST_HELD:
                    yield pa.RecordBatch.from_arrays([pa.array([*held], pa.string()), pa.array([*held.values()], pa.int64())], ["token", "n"])
                    held.clear()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([*held], pa.string()), pa.array([*held.values()], pa.int64())], ["token", "n"])

    def encode(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pieces_of(model_path, batch.column(0).to_pylist()), pa.int64())], ["token", "n", "pieces"])

    found = docs.select("text").mapInArrow(gather, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return materialize(found.mapInArrow(encode, "token string, n long, pieces long"))


def most_frequent(words: DataFrame, most: int = MOST_SENT) -> dict[str, int]:
    """Pieces of the most frequent short pre-tokens, `most` at most: those from a power of two on, so that nothing is sorted."""
    short = words.where(F.length("token") <= LONGEST_SENT)
    power = F.floor(F.log2("n")).cast("int")
    total, least = 0, None
    for r in sorted(short.groupBy(power.alias("k")).count().collect(), key=lambda r: -r["k"]):  # 63 rows at most
        total += r["count"]
        if total > most:
            break
        least = r["k"]
    return {} if least is None else {r.token: r.pieces for r in short.where(power >= least).select("token", "pieces").toLocalIterator()}


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, most_sent: int = MOST_SENT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row."""
    spark = docs.sparkSession
    small_batches(spark)
    words = vocabulary(docs, model_path)
    sent = spark.sparkContext.broadcast(most_frequent(words, most_sent))
    schema = docs.select("doc_id").schema.add("n_bytes", "long").add("known", "long").add("rest", ArrayType(StructType().add("token", "string").add("n", "long")))

    def count(batches):
        pieces = sent.value
        for batch in batches:
            _, at = utf8(batch.column("text"))
            known, rest = [], []
            for text in batch.column("text"):
                total, others = 0, []
                for token, n in Counter(pre_tokens(text.as_py())).items():
                    if (k := pieces.get(token)) is None:
                        others.append({"token": token, "n": n})
                    else:
                        total += n * k
                known.append(total)
                rest.append(others or None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at), pa.int64()), pa.array(known, pa.int64()), pa.array(rest, REST)], schema.names)

    # Written once, so that a row's number stays what it is.
    counted = materialize(docs.select("doc_id", "text").mapInArrow(count, schema).withColumn("row", F.monotonically_increasing_id()))
    asked = counted.where("rest is not null").select("row", F.explode("rest").alias("x")).select("row", "x.*")
    summed = asked.join(words.select("token", "pieces"), "token").groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("more"))
    open_ = counted.where("rest is not null").select("row", "doc_id", "n_bytes", "known").join(summed, "row")
    done = counted.where("rest is null").select("doc_id", "n_bytes", F.col("known").alias("n_tokens"))
    both = done.union(open_.select("doc_id", "n_bytes", (F.col("known") + F.col("more")).alias("n_tokens")))
    return both.withColumn("over_limit", F.col("n_tokens") > limit)
