"""Chroma audio fingerprints: integral-image filters over pitch-class frames, and alignment."""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import ship, staged

RATE, FRAME, HOP, CHROMA = 5512, 2048, 683, 12
#: Frames under each filter, and frames between the three half items that make a key of the index.
WIDTH, STRIDE = 16, 5
LOWEST, HIGHEST = 55.0, 2600.0


def decode_wav(data: bytes) -> tuple[np.ndarray, int]:
    """Samples in -1..1, channels averaged, and the rate of 16-bit PCM WAV; broken data is silence."""
    try:
        with wave.open(io.BytesIO(data)) as file:
            raw = np.frombuffer(file.readframes(file.getnframes()), "<i2")
            return raw[: len(raw) // file.getnchannels() * file.getnchannels()].reshape(-1, file.getnchannels()).mean(1) / 32768.0, file.getframerate()
    except (wave.Error, EOFError, ValueError):
        return np.zeros(0), RATE


def encode_wav(samples: np.ndarray, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setnchannels(1)
        file.setsampwidth(2)
        file.setframerate(rate)
        file.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def sonify(vector: list[float], note: int = 689) -> tuple[np.ndarray, int]:
    """A recording of a vector: a tone of `note` samples for each value, its pitch on a scale of three
    octaves by the value. Not finite or missing values rest."""
    values = np.array([np.nan if x is None else x for x in vector or ()], dtype=np.float64)
    pitch = np.where(np.isfinite(values), np.round(np.tanh(np.nan_to_num(values) * 3) * 18), 0)
    step = np.where(np.isfinite(values), 440.0 * 2 ** (pitch / 12) / RATE, 0.0)
    phase = np.cumsum(np.repeat(step, note))
    return np.sin(2 * np.pi * phase) * np.repeat(np.isfinite(values), note) * 0.5, RATE


def _pitch_classes() -> np.ndarray:
    frequency = np.arange(FRAME // 2 + 1) * RATE / FRAME
    table = np.zeros((len(frequency), CHROMA))
    inside = np.nonzero((frequency >= LOWEST) & (frequency <= HIGHEST))[0]
    table[inside, np.round(12 * np.log2(frequency[inside] / 440.0)).astype(int) % CHROMA] = 1
    return table


PITCH_CLASSES, TAPER = _pitch_classes(), np.hanning(FRAME)


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """Energy of each pitch class by frame, each frame scaled to length 1 (silence stays 0)."""
    if rate != RATE and len(samples):
        at = np.arange(0, len(samples) - 1, rate / RATE)
        samples = np.interp(at, np.arange(len(samples)), samples)
    if len(samples) < FRAME:
        return np.zeros((0, CHROMA))
    out = []
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    for k in range(0, len(frames), 256):
        spectrum = np.fft.rfft(frames[k : k + 256] * TAPER)
        out.append((spectrum.real**2 + spectrum.imag**2) @ PITCH_CLASSES)
    energy = np.concatenate(out)
    size = np.sqrt((energy**2).sum(1, keepdims=True))
    return np.where(size > 1e-4, energy / np.maximum(size, 1e-12), 0.0)


def _filters() -> list[tuple[int, int, int, int]]:
    """(kind, lowest class, classes, frames): 16 rectangles of different place, height and width, the
    six kinds being sum, halves by class, halves by time, quarters, thirds by class, thirds by time."""
    return [(k % 6, (5 * k) % CHROMA % (CHROMA - height + 1), height, width) for k, (height, width) in enumerate([(3, 16), (4, 14), (8, 4), (4, 4), (6, 8), (4, 12), (6, 16), (8, 8), (2, 16), (8, 16), (9, 6), (3, 15), (12, 10), (2, 8), (10, 12), (6, 6)])]


FILTERS = _filters()


def fingerprint(frames: np.ndarray) -> np.ndarray:
    """An unsigned 32-bit item for each WIDTH frames: two bits of each filter, Gray-coded.

    A filter compares the sums of two sets of rectangles, each read off an integral image by its
    corners; its answer, the difference over the total, is cut at -0.1, 0 and 0.1 (the sum alone at
    the shares that a flat image would give, one half more and one half less).
    """
    count = len(frames) - WIDTH + 1
    if count <= 0:
        return np.zeros(0, np.uint32)
    integral = np.zeros((len(frames) + 1, CHROMA + 1))
    integral[1:, 1:] = np.cumsum(np.cumsum(frames, 0), 1)
    t = np.arange(count)

    def area(t0: int, t1: int, c0: int, c1: int) -> np.ndarray:
        return integral[t + t1, c1] - integral[t + t0, c1] - integral[t + t1, c0] + integral[t + t0, c0]

    items = np.zeros(count, np.uint32)
    for kind, low, height, width in FILTERS:
        whole = area(0, width, low, low + height)
        half_c, half_t, third_c, third_t = low + height // 2, width // 2, max(1, height // 3), max(1, width // 3)
        if kind == 0:
            everything = area(0, width, 0, CHROMA)
            value = np.where(everything > 0, whole * CHROMA / np.maximum(everything, 1e-12) / height - 1, 0) / 5
        else:
            part = (
                area(0, width, half_c, low + height) if kind == 1
                else area(half_t, width, low, low + height) if kind == 2
                else area(0, half_t, half_c, low + height) + area(half_t, width, low, half_c) if kind == 3
                else area(0, width, low + third_c, low + height - third_c) if kind == 4
                else area(third_t, width - third_t, low, low + height)
            )
            value = np.where(whole > 1e-9, 2 * part / np.maximum(whole, 1e-9) - 1, 0)
        level = (value > -0.1).astype(np.uint32) + (value > 0) + (value > 0.1)
        items = (items << np.uint32(2)) | (level ^ (level >> 1)).astype(np.uint32)
    return items


def fingerprints(recordings: DataFrame, key: str, column: str, decode: Callable[[object], tuple[np.ndarray, int]] = decode_wav) -> DataFrame:
    """(id, items): packed little-endian items of each row's media column, through `decode`.

    Null or empty media, and recordings too short for one item, have none. Rows are worked on one at a
    time; repeated rows and null ids are kept as they are.
    """
    ship(recordings.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = [fingerprint(chroma(*decode(x.as_py()))).astype("<u4").tobytes() if x.is_valid else b"" for x in batch.column("media")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(items, pa.binary())], names=["id", "items"])

    return recordings.select(F.col(key).cast("long").alias("id"), F.col(column).alias("media")).mapInArrow(run, "id long, items binary")


def class_members(prints: DataFrame) -> DataFrame:
    """(id, items, class_id): class_id is the smallest id of equal fingerprints. Copies are gathered by
    digest with map-side minima, never into lists."""
    marked = prints.withColumn("digest", F.sha2("items", 256))
    first = marked.groupBy("digest").agg(F.min("id").alias("class_id"))
    return marked.join(first, "digest").select("id", "items", "class_id")


def index_keys(items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, place, length) of runs of equal keys: of every three items STRIDE frames apart their upper
    and their lower halves. Where a tone or silence holds, the same key comes frame after frame; such
    a run is one row."""
    wide = items.astype(np.int64)
    room = max(0, len(wide) - 2 * STRIDE)
    keys, places, lengths = [], [], []
    for tag, shift in ((1, 16), (2, 0)):
        half = (wide >> shift) & 0xFFFF
        key = (tag << 60) | (half[:room] << 32) | (half[STRIDE : STRIDE + room] << 16) | half[2 * STRIDE : 2 * STRIDE + room]
        start = np.nonzero(np.append(True, key[1:] != key[:-1]))[0] if room else np.zeros(0, np.int64)
        keys.append(key[start])
        places.append(start)
        lengths.append(np.diff(np.append(start, room)) if room else start)
    return np.concatenate(keys), np.concatenate(places), np.concatenate(lengths)


#: What a probe asks for: a key, and it with each one of its 48 bits the other way.
FLIPS = np.array([0, *(1 << bit for bit in range(48))], np.int64)


def align(queries: DataFrame, classes: DataFrame, most_errors: float = 0.125, least_overlap: int = 16) -> DataFrame:
    """(query, match, offset, overlap, bit_errors) of classes (class_id, items) against one another.

    Keys in common (see index_keys), also those that one wrong bit has changed, vote for an offset;
    the offset of most votes (of ties the smallest) is then judged on all overlapping items by the
    share of bits that differ. Every vote counts; nothing is capped. Two runs of one key vote for all
    offsets at which they overlap, each as often as frames then meet, in one row for each offset: as
    many as the runs are long, not as their product. Classes without items, and those of null id,
    give no row; a class repeated in the input votes as often as it comes.
    """

    def keys(batches: Iterator[pa.RecordBatch], probe: bool) -> Iterator[pa.RecordBatch]:
        flips = FLIPS if probe else FLIPS[:1]
        for batch in batches:
            for k in range(0, batch.num_rows, 100):
                some = batch.slice(k, 100)
                coded = [index_keys(np.frombuffer(x.as_py() or b"", "<u4")) for x in some.column("items")]
                owner = np.repeat(some.column("class_id").to_numpy(zero_copy_only=False), [len(x) for x, _, _ in coded])
                key, at, length = (np.concatenate(x) for x in zip(*coded, strict=True))
                columns = np.repeat(owner, len(flips)), (key[:, None] ^ flips).ravel(), np.repeat(at, len(flips)), np.repeat(length, len(flips))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["class_id", "key", "at", "length"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in zip(*(batch.column(x) for x in ("query", "match", "offset", "query_items", "match_items")), strict=True):
                query, match, offset, a, b = (x.as_py() for x in row)
                x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
                x, y = x[max(0, -offset) :], y[max(0, offset) :]
                size = min(len(x), len(y))
                errors = int(np.bitwise_count(x[:size] ^ y[:size]).sum(dtype=np.int64))
                if size >= least_overlap and errors <= most_errors * 32 * size:
                    rows.append((query, match, offset, size, errors))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["query", "match", "offset", "overlap", "bit_errors"])

    schema = "class_id long, key long, at long, length long"
    named = [x.where(F.col("class_id").isNotNull()) for x in (queries, classes)]
    asked = named[0].mapInArrow(lambda x: keys(x, True), schema).select(F.col("class_id").alias("query"), "key", F.col("at").alias("query_at"), F.col("length").alias("query_length"))
    held = named[1].mapInArrow(lambda x: keys(x, False), schema).select(F.col("class_id").alias("match"), "key", "at", "length")
    first, last = F.col("at") - F.col("query_at") - F.col("query_length") + 1, F.col("at") - F.col("query_at") + F.col("length") - 1
    offset = F.col("offset")
    meeting = F.least("length", "query_length", offset - F.col("first") + 1, F.col("last") - offset + 1)
    met = asked.join(held, "key").where("query <> match").select("query", "match", "length", "query_length", first.alias("first"), last.alias("last"))
    votes = met.select("*", F.explode(F.sequence("first", "last")).alias("offset")).groupBy("query", "match", "offset").agg(F.sum(meeting).alias("n"))
    best = votes.groupBy("query", "match").agg(F.max_by("offset", F.struct("n", -F.col("offset"))).alias("offset"))
    left = named[0].select(F.col("class_id").alias("query"), F.col("items").alias("query_items"))
    right = named[1].select(F.col("class_id").alias("match"), F.col("items").alias("match_items"))
    return best.join(left, "query").join(right, "match").mapInArrow(judge, "query long, match long, offset long, overlap long, bit_errors long")


def search(recordings: DataFrame, key: str, column: str, decode: Callable[[object], tuple[np.ndarray, int]] = decode_wav, every: int = 20) -> DataFrame:
    """Each recording with its fingerprint and class, and for the classes of rows whose id is divisible
    by `every` the classes that align with them; one row for each match, or one with null match.

    Recordings without items (null, empty, broken or too short media), and those whose id is null, are
    in classes but neither ask nor match. Repeated rows give their rows again; an empty table gives an
    empty one; other columns of the input, of any name, are not looked at. Fingerprints are made once
    and written, since classes and members both read them.
    """
    prints = staged(fingerprints(recordings, key, column, decode), "audio-prints")
    members = staged(class_members(prints), "audio-classes")
    usable = members.where("length(items) > 0 and id is not null")
    classes = usable.where("id = class_id").select("class_id", "items").dropDuplicates(["class_id"])
    asking = usable.where(F.col("id") % every == 0).select("class_id").distinct()
    found = align(classes.join(asking, "class_id", "left_semi"), classes)
    asked = members.withColumn("query", F.when((F.col("id") % every == 0) & (F.length("items") > 0), F.col("class_id")))
    joined = asked.join(found, "query", "left")
    return joined.select("id", (F.length("items") / 4).cast("long").alias("n_items"), F.sha2("items", 256).alias("items_sha256"), "class_id", "match", "offset", "overlap", "bit_errors")
