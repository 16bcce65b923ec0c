"""Byte-level BPE with tiktoken: encoding, decoding and token counts."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import ship

#: Rows worked on together in a task.
ROWS = 256
#: Texts longer than this many characters are encoded in parts.
PART = 1 << 16
#: Between a character that no definition calls white space and one that all do, every match of the
#: supported patterns ends: their alternatives hold white space only at their start or throughout.
SAFE = re.compile(r"(?<=[^\s\x1c-\x1f\x85])(?=[ \t\r\n])")


def parts(text: str, size: int = PART) -> Iterator[str]:
    """Cut text at safe boundaries, each part of at least size characters but the last."""
    start = 0
    while len(text) - start > size:
        found = SAFE.search(text, start + size)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:] if start else text


@lru_cache(maxsize=4)
def encoding(rank_file: bytes, pattern: str) -> tiktoken.Encoding:
    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in rank_file.splitlines() if line)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode_text(coder: tiktoken.Encoding, text: str | None) -> list[int]:
    if not text:
        return []
    if len(text) <= PART:
        return coder.encode_ordinary(text)
    return [i for part in parts(text) for i in coder.encode_ordinary(part)]


class ByteBpe:
    """A vocabulary read from a local rank file on the driver and broadcast (its size is that of the
    vocabulary, not of the data).

    Null texts encode as empty ones. Texts are taken whole; special tokens are never recognised.
    """

    def __init__(self, spark: SparkSession, rank_path: str, pattern: str):
        ship(spark)
        self.pattern = pattern
        self.ranks = spark.sparkContext.broadcast(Path(rank_path).read_bytes())

    def _map(self, df: DataFrame, of: str, to: str, work: Callable[[tiktoken.Encoding, object], bytes]) -> DataFrame:
        """df and a binary column `to` of the column `of`, made a few rows at a time."""
        ranks, pattern = self.ranks, self.pattern

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            coder = encoding(ranks.value, pattern)
            for whole in batches:
                for k in range(0, whole.num_rows, ROWS):
                    batch = whole.slice(k, ROWS)
                    made = pa.array([work(coder, x.as_py()) for x in batch.column(of)], pa.binary())
                    kept = [n for n in batch.schema.names if n != "text"]
                    yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), made], names=[*kept, to])

        kept = [f for f in df.schema.fields if f.name != "text"]
        return df.mapInArrow(run, T.StructType([*kept, T.StructField(to, T.BinaryType())]))

    def encode(self, documents: DataFrame) -> DataFrame:
        """(doc_id, ids): ids as little-endian unsigned 32-bit integers, none for a null or empty text.
        A row for each row, repeated ones and those of null id too; no row for an empty table."""
        return self._map(documents.select("doc_id", "text"), "text", "ids", lambda coder, x: np.array(encode_text(coder, x), dtype="<u4").tobytes())

    def decode(self, encoded: DataFrame) -> DataFrame:
        """(doc_id, ids, decoded): the raw bytes of packed ids; they need not be valid UTF-8. Null and
        empty ids give no bytes; a row for each row, as in encode."""
        return self._map(encoded.select("doc_id", "ids"), "ids", "decoded", lambda coder, x: coder.decode_bytes(np.frombuffer(x or b"", dtype="<u4").tolist()))

    def count(self, text: Column) -> Column:
        """How many ids a text has; 0 for null."""
        ranks, pattern = self.ranks, self.pattern

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            coder = encoding(ranks.value, pattern)
            for batch in batches:
                yield pa.array([len(encode_text(coder, x.as_py())) for x in batch], pa.int64())

        run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        return F.arrow_udf(run, "bigint")(text)


def round_trip(documents: DataFrame, coder: ByteBpe) -> DataFrame:
    """doc_id, ids, decoded of every row; repeated rows and null ids are kept as they are."""
    return coder.decode(coder.encode(documents))


def digests(documents: DataFrame, coder: ByteBpe) -> DataFrame:
    return round_trip(documents, coder).select(
        "doc_id",
        F.expr("length(ids) div 4").cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
