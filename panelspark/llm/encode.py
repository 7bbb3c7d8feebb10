"""Problem 8: the whole corpus as token ids of a public tokenizer."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.bpe import Encoder, encoder

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
FLUSH = 500_000  # ids or characters gathered before a batch is handed on; bounds a worker's memory


def texts_of(column: pa.Array) -> Iterator[str | None]:
    """Texts of a column; bytes that are no UTF-8 become the replacement character."""
    for b in column.cast(pa.binary()):
        v = b.as_py()
        yield None if v is None else v.decode("utf-8", "replace")


def load(spark: SparkSession, path: str = TOKENIZER) -> Callable[[], Encoder]:
    """A function for workers that gives their encoder. The file (1.5 MB) is read by the driver and broadcast."""
    shared = spark.sparkContext.broadcast(Path(path).read_bytes())
    return lambda: encoder(shared.value)


def encode_corpus(df: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, ids``: the ids of every row's text, without special tokens, whose strings are ordinary text.

    One pass without a shuffle. A null or empty text has an empty list; blanks are text and have ids; repeated rows
    and null ids stay as they are; texts are encoded whole, however long; an empty table gives no rows; other columns
    are ignored, whatever their names.
    """
    get = load(df.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = get()

        def pack(keys: pa.Array, lists: list[list[int]]) -> pa.RecordBatch:
            offsets = np.concatenate([[0], np.cumsum(list(map(len, lists)))]).astype("int32")
            flat = np.fromiter(chain.from_iterable(lists), "int32", int(offsets[-1]))
            return pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(offsets, flat)], ["doc_id", "ids"])

        for batch in batches:
            start, size, lists = 0, 0, []
            for k, t in enumerate(texts_of(batch.column(1))):
                lists.append(enc.encode(t))
                size += len(lists[-1])
                if size >= FLUSH:
                    yield pack(batch.column(0).slice(start, len(lists)), lists)
                    start, size, lists = k + 1, 0, []
            if lists:
                yield pack(batch.column(0).slice(start, len(lists)), lists)

    key = df.schema[doc_id].dataType.simpleString()
    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {key}, ids array<int>")


def count_tokens(df: DataFrame, keep: list[str], text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """The kept columns and ``n_tokens`` of every row; 0 for null and empty texts. One pass without a shuffle."""
    get = load(df.sparkSession, tokenizer)
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = get()
        for batch in batches:
            counts = pa.array([enc.count(t) for t in texts_of(batch.column(n))], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], counts], [*batch.schema.names[:n], "n_tokens"])

    chosen = df.select(*keep, F.col(text).cast("string").alias("_text_"))
    schema = ", ".join(f"`{c}` {chosen.schema[c].dataType.simpleString()}" for c in keep)
    return chosen.mapInArrow(run, f"{schema}, n_tokens bigint")
