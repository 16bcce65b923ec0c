"""Packing of neighbouring documents into sequences, in the order of a Hilbert curve."""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quern.llm.common import TEXT_ROWS, partitions_for, releasing, ship, staged

DIMENSIONS = 4
CURVE_BITS = 15
#: Words, and pieces of words, that a worker keeps.
CACHED_WORDS, CACHED_PIECES = 1_200_000, 500_000
#: The first character beyond the Latin blocks.
LATIN = "\u0250"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte: itself where it can be printed,
    else the next free one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return {b: chr(b if b in shown else next(spare)) for b in range(256)}


BYTE_LETTERS = byte_letters()


@lru_cache(maxsize=2)
def tokenizer(definition: bytes) -> Tokenizer:
    loaded = Tokenizer.from_buffer(definition)
    loaded.encode_special_tokens = True
    loaded.no_padding()
    loaded.no_truncation()
    return loaded


class WordEncoder:
    """Encodes texts with a byte-level BPE tokenizer, each word and each piece of a word once.

    Its pre-tokenizer lets white space stand only at the start of a piece, and in a run of white
    space the last blank goes with the word that follows. So a blank between two characters that are
    not white space always starts a new piece, and a text is the concatenation of its words, each
    with the blank before it. A text that holds white space beside a blank is encoded as it stands.
    With the pre-tokenizer's pattern, new words of Latin letters (on which all Unicode versions agree)
    are made of the pieces that it finds, and only the merges of a new piece are left to the library.
    """

    def __init__(self, definition: bytes, pattern: str | None = None):
        self.tokenizer = tokenizer(definition)
        self.model = self.tokenizer.model
        self.find = regex.compile(pattern).findall if pattern else None
        self.words: dict[str, bytes | None] = {}
        self.pieces: dict[str, bytes] = {}

    def whole(self, batch: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)]

    def piece(self, text: str) -> bytes:
        return array("I", [x.id for x in self.model.tokenize(text.encode().decode("latin-1").translate(BYTE_LETTERS))]).tobytes()

    def learn(self, new: list[str]) -> None:
        """Encode words (with the blank before them); None marks those that are not whole words."""
        known, pieces, find, other = self.words, self.pieces, self.find, []
        if len(pieces) > CACHED_PIECES:
            pieces.clear()
        for w in new:
            if not w or w[0].isspace() or w[-1].isspace():
                known[w] = None
            elif find and (w.isascii() or max(w) < LATIN):
                parts = (" " + w,) if w.isalpha() else (" " + w[:-1], w[-1]) if w[-1] in ".,;:!?" and w[:-1].isalpha() else find(" " + w)
                coded = b""
                for p in parts:
                    ids = pieces.get(p)
                    if ids is None:
                        ids = pieces[p] = self.piece(p)
                    coded += ids
                known[w] = coded
            else:
                other.append(w)
        for k in range(0, len(other), 4096):
            some = other[k : k + 4096]
            known.update(zip(some, self.whole([" " + w for w in some]), strict=True))

    def encode(self, column: pa.Array) -> list[bytes]:
        """Packed ids of each text of an Arrow column (null as empty). Words are split, numbered and
        put together by Arrow; Python sees each word once."""
        filled = pc.fill_null(column.cast(pa.large_string()), "")
        split = pc.split_pattern(filled, " ")
        starts = split.offsets.to_numpy()
        numbered = split.flatten().dictionary_encode()
        names, at = numbered.dictionary.to_pylist(), numbered.indices.to_numpy().astype(np.int64)
        if len(self.words) > CACHED_WORDS:
            self.words.clear()
        self.learn([w for w in names if w not in self.words])
        coded = list(map(self.words.__getitem__, names))
        firsts = [names[k] for k in at[starts[:-1]]]
        many = np.diff(starts) > 1
        broken = np.fromiter((x is None for x in coded), bool, len(coded))[at]
        broken[starts[:-1]] = many & np.fromiter((not w or w[-1].isspace() for w in firsts), bool, len(firsts))
        odd = np.nonzero(np.logical_or.reduceat(broken, starts[:-1]))[0] if len(firsts) else []
        at[starts[:-1]] = len(coded) + np.arange(len(firsts))
        taken = pa.array([x or b"" for x in coded] + self.whole(firsts), pa.large_binary()).take(pa.array(at))
        bounds = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(taken) + 1][starts]
        data = memoryview(taken.buffers()[2])
        out = [bytes(data[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        for k, ids in zip(odd, self.whole([filled[k].as_py() for k in odd]), strict=True):
            out[k] = ids
        return out


def directions(size: int, dimensions: int = DIMENSIONS, seed: int = 5) -> np.ndarray:
    """A fixed random sign for each token id and dimension: hashed projection of a bag of tokens."""
    return np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (size, dimensions))


def hilbert_key(points: np.ndarray, bits: int = CURVE_BITS) -> np.ndarray:
    """Place along the Hilbert curve of integer points (rows) with `bits` bits for each dimension,
    by Skilling's transform between axes and transposed index."""
    axes = [points[:, k].astype(np.int64).copy() for k in range(points.shape[1])]
    count = len(axes)
    bit = 1 << (bits - 1)
    while bit > 1:
        mask = bit - 1
        for k in range(count):
            high = (axes[k] & bit) != 0
            swap = np.where(high, 0, (axes[0] ^ axes[k]) & mask)
            axes[0] = np.where(high, axes[0] ^ mask, axes[0] ^ swap)
            if k:
                axes[k] ^= swap
        bit >>= 1
    for k in range(1, count):
        axes[k] ^= axes[k - 1]
    turn = np.zeros_like(axes[0])
    bit = 1 << (bits - 1)
    while bit > 1:
        turn = np.where((axes[-1] & bit) != 0, turn ^ (bit - 1), turn)
        bit >>= 1
    key = np.zeros_like(axes[0])
    for level in range(bits - 1, -1, -1):
        for k in range(count):
            key = (key << 1) | (((axes[k] ^ turn) >> level) & 1)
    return key


def curve_keys(bags: list[np.ndarray], signs: np.ndarray) -> np.ndarray:
    """Hilbert keys of documents given as arrays of token ids."""
    means = np.array([signs[ids].mean(0, dtype=np.float64) if len(ids) else np.zeros(signs.shape[1]) for ids in bags])
    scaled = (means + 0.5) * (1 << CURVE_BITS)
    return hilbert_key(np.clip(scaled, 0, (1 << CURVE_BITS) - 1).astype(np.int64))


def tokenized(documents: DataFrame, definition: bytes, end_id: int, pattern: str | None) -> DataFrame:
    """doc_id, key on the curve and packed ids (end_id last) of every row."""
    ship(documents.sparkSession)
    size = max(tokenizer(definition).get_vocab_size(), end_id + 1)
    kind = "<u2" if size <= 1 << 16 else "<u4"
    shared = documents.sparkSession.sparkContext.broadcast(definition)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, signs = WordEncoder(shared.value, pattern), directions(size)
        for whole in batches:
            for at in range(0, whole.num_rows, TEXT_ROWS):
                batch = whole.slice(at, TEXT_ROWS)
                bags = [np.append(np.frombuffer(x, "<u4"), end_id).astype(kind) for x in coder.encode(batch.column("text"))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(curve_keys(bags, signs)), pa.array([x.tobytes() for x in bags], pa.binary())], names=["doc_id", "key", "ids"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, key long, ids binary")


class Packer:
    """Cuts a stream of documents into sequences of exactly `size` tokens and, at the end, the rest
    into sequences whose lengths are falling powers of two: none of them needs padding."""

    def __init__(self, size: int, first: int):
        self.size, self.next, self.open, self.used = size, first, [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        at = 0
        while at < len(ids):
            take = min(self.size - self.used, len(ids) - at)
            self.open.append((doc_id, at, ids[at : at + take], len(ids)))
            self.used += take
            at += take
            if self.used == self.size:
                yield from self._close(self.open)
                self.open, self.used = [], 0

    def _close(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc_id, start, ids, total in pieces:
            yield doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next, offset
            offset += len(ids)
        self.next += 1

    def finish(self) -> Iterator[tuple]:
        waiting, rest = self.open[::-1], self.used
        while rest:
            room = 1 << (rest.bit_length() - 1)
            rest -= room
            part = []
            while room:
                doc_id, start, ids, total = waiting.pop()
                if len(ids) > room:
                    waiting.append((doc_id, start + room, ids[room:], total))
                    ids = ids[:room]
                part.append((doc_id, start, ids, total))
                room -= len(ids)
            yield from self._close(part)
        self.open, self.used = [], 0


def pack(documents: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 1, pattern: str | None = None) -> DataFrame:
    """One row for each piece of a document, in sequences of `size` tokens along the curve.

    Every row of documents counts: null and empty texts are a document of end_id alone, repeated rows
    are packed each, null ids are carried. Documents are range-sorted by curve key and then id, so
    copies under one key spread over tasks. There are as many ranges as the input has shares of 32 MB,
    so a task stays as large as it is; it streams through its range and holds one sequence. An empty
    table gives an empty one; other columns of the input, of any name, are not looked at.
    pattern: of the tokenizer's pre-tokenizer, if known; it only saves time.
    sequence_id is unique over the result: the task's number above 40 bits, a count below.
    """
    with open(tokenizer_path, "rb") as file:
        definition = file.read()
    coded = staged(tokenized(documents, definition, end_id, pattern), "packing-ids", arrow_rows=TEXT_ROWS)
    kind = "<u2" if max(tokenizer(definition).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(size, TaskContext.get().partitionId() << 40)
        names = [x.split()[0] for x in PIECES.split(", ")]

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=names)

        for batch in batches:
            if rows := [row for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True) for row in packer.add(doc_id, np.frombuffer(ids.as_buffer(), kind))]:
                yield made(rows)
        if rows := list(packer.finish()):
            yield made(rows)

    # Tasks that encode keep their memory from one to the next; those that pack follow in the same workers and release it.
    ordered = coded.repartitionByRange(partitions_for(documents), "key", "doc_id").sortWithinPartitions("key", "doc_id", F.crc32("ids"))
    return ordered.select("doc_id", "ids").mapInArrow(releasing(run), PIECES)
