"""Removal of repeated byte strings: anchored candidate search, then deep-shallow suffix sorting.

Every string of `length` bytes has one anchor: of its 32-byte grams the one of least hash, the first
of equals. Equal strings have equal anchors at equal places, so strings whose anchor occurs once in
the corpus are not repeated, and equal strings meet in the partition of their anchor. That search is
lossless.

What meets is then settled in three steps. Whole texts that are equal by SHA-256 are settled before
the search. Around one anchor, contexts (all bytes of the strings that have it at one place) that are
equal byte by byte are one. Different contexts of an anchor are cut into their strings, which are
sorted by their bytes. Only around anchors that occur very often a string goes by its 128-bit XXH3
digest instead, so there equality rests on the digest.
"""

from __future__ import annotations

import atexit
import hashlib
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import TEXT_ROWS, new_folder, partitions_for, releasing, ship, spare, staged

GRAM = 32
#: Bytes hashed at a time; also the room for positions below a truncated hash.
CHUNK_BITS = 20
SHALLOW = 24
#: Anchors, and bytes of contexts, that a map task holds before it sends them on.
ANCHORS_HELD = 1 << 20
CONTEXT_BYTES_HELD = 32 << 20
#: Bytes of contexts whose windows are sorted together.
SORTED_BYTES = 2 << 20

_random = np.random.default_rng(20)
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _random.integers(1, 1 << 62, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position, by doubling."""
    value, span, step = _BYTE[data], 1, 0
    while span < GRAM:
        value = value[:-span] * _STEP[step] + value[span:]
        span, step = span * 2, step + 1
    value ^= value >> np.uint64(31)
    value *= _STEP[7]
    value ^= value >> np.uint64(29)
    return value


def anchors(documents: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: (document, first start, count, anchor's offset from it, hash).

    Documents longer than a chunk are taken in overlapping parts; a run may end at a part's edge.
    """
    found: list[tuple[np.ndarray, ...]] = []
    room, wide = (1 << CHUNK_BITS) - 1, length - GRAM + 1
    pending: list[tuple[int, int, bytes]] = []
    size = 0

    def flush() -> None:
        nonlocal pending, size
        if not pending:
            return
        sizes = np.array([len(x) for _, _, x in pending])
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(x for _, _, x in pending), np.uint8)
        hashes = gram_hashes(data)
        low = np.uint64(room)
        value = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
        least, span = value, 1
        while span * 2 <= wide:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if wide > span:
            least = np.minimum(least[: len(least) - (wide - span)], least[wide - span :])
        at = (least & low).astype(np.int64)
        owner = np.repeat(np.arange(len(pending)), sizes)[: len(at)]
        start = np.arange(len(at))
        fits = start + length <= ends[owner]
        start, owner, at = start[fits], owner[fits], at[fits]
        first = np.ones(len(start), bool)
        first[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
        run = np.nonzero(first)[0]
        count = np.diff(np.append(run, len(start)))
        number = np.array([k for k, _, _ in pending])[owner[run]]
        base = np.array([b for _, b, _ in pending]) - (ends - sizes)
        found.append((number, start[run] + base[owner[run]], count, at[run] - start[run], hashes[at[run]]))
        pending, size = [], 0

    for k, text in enumerate(documents):
        step = room - 2 * length
        for begin in range(0, max(1, len(text) - length + 1), step) if len(text) >= length else ():
            part = text[begin : begin + step + length - 1]
            if len(part) >= length:
                if size + len(part) > room:
                    flush()
                pending.append((k, begin, part))
                size += len(part)
    flush()
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def suffix_ranks(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Ranks of the strings of `length` bytes at starts in sorted order; equal strings share a rank.

    Deep-shallow: a multikey quicksort with symbols of eight bytes goes to SHALLOW bytes, and groups
    that agree so far, whose common prefixes are long, are ordered by blind tries. In both all groups
    are worked on together, a step at a time.
    """
    word = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    for span in (1, 2, 4):
        word = (word[:-span] << np.uint64(8 * span)) | word[span:]
    depths = [*range(0, length - 7, 8)]
    if length % 8:
        depths.append(max(0, length - 8))
    depths = np.array(depths)
    short = np.uint64(64 - 8 * length) if length < 8 else None

    def symbol(where: np.ndarray, level: np.ndarray | int) -> np.ndarray:
        got = word[starts[where] + depths[level]]
        return got >> short if short is not None else got

    rank = np.zeros(len(starts), np.int64)
    shallow = int((depths < SHALLOW).sum())
    active = quicksorted(symbol, rank, shallow)
    blind_tries(symbol, rank, active, shallow, len(depths))
    return rank


def split(rank: np.ndarray, members: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order members of groups (equal rank) by keys, the first the weightiest, and give each part a
    rank of its own. Returns members in order, the order, and where a part begins."""
    order = np.lexsort((*keys[::-1], rank[members]))
    members = members[order]
    old, place = rank[members], np.arange(len(members))
    group = np.ones(len(members), bool)
    group[1:] = old[1:] != old[:-1]
    part = group.copy()
    for key in keys:
        part[1:] |= key[order][1:] != key[order][:-1]
    rank[members] = old + np.maximum.accumulate(np.where(part, place, 0)) - np.maximum.accumulate(np.where(group, place, 0))
    return members, order, part


def quicksorted(symbol, rank: np.ndarray, levels: int) -> np.ndarray:
    """Multikey quicksort: each group is parted in three by a pivot, the median of three of its
    members' symbols; what equals the pivot goes a symbol deeper, the rest stays at its depth.
    Returns members of groups of two or more that agree in `levels` symbols."""
    active, level, done = np.arange(len(rank)), np.zeros(len(rank), np.int64), []
    while len(active) and levels:
        first = np.nonzero(np.append(True, rank[active][1:] != rank[active][:-1]))[0]
        sizes = np.diff(np.append(first, len(active)))
        key = symbol(active, level)
        three = np.sort(np.stack([key[first], key[first + sizes // 2], key[first + sizes - 1]]), axis=0)
        pivot = np.repeat(three[1], sizes)
        side = (key > pivot).astype(np.int8) + (key >= pivot)
        active, order, part = split(rank, active, side)
        level = level[order] + (side[order] == 1)
        alone = part & np.append(part[1:], True)
        deep = ~alone & (level >= levels)
        done.append(active[deep])
        active, level = active[~alone & ~deep], level[~alone & ~deep]
    found = np.concatenate(done) if done else active
    return found[np.argsort(rank[found], kind="stable")]


def blind_tries(symbol, rank: np.ndarray, active: np.ndarray, level: int, levels: int) -> None:
    """Order groups that agree in `level` symbols, by a blind trie for each.

    A round puts a group's strings on the path of its first one: each is compared with it once, from
    the level known to be common, up to the first symbol that differs. The path has nodes only at
    levels where some string leaves it; what lies between is skipped. Strings below the first come in
    order of the level where they leave it, those above in reverse order; the ones that leave at one
    node by one symbol are a subtrie, which the next round begins below that node. Strings that never
    leave the path are equal to the first.
    """
    known = np.full(len(active), level)
    while len(active):
        first = np.nonzero(np.append(True, rank[active][1:] != rank[active][:-1]))[0]
        leader = np.repeat(active[first], np.diff(np.append(first, len(active))))
        leaves = np.full(len(active), levels)
        on_path = np.arange(len(active))
        for k in range(int(known.min()), levels):
            here = on_path[known[on_path] <= k]
            off = here[symbol(active[here], k) != symbol(leader[here], k)]
            leaves[off] = k
            on_path = on_path[leaves[on_path] == levels]
        own = np.minimum(leaves, levels - 1)
        mine, path = symbol(active, own), symbol(leader, own)
        side = np.where(leaves == levels, 1, np.where(mine < path, 0, 2))
        node = np.where(side == 2, -leaves, leaves)
        active, order, part = split(rank, active, side, node, np.where(side == 1, 0, mine))
        open_ = (side[order] != 1) & ~(part & np.append(part[1:], True))
        active, known = active[open_], leaves[order][open_] + 1
        # Strings of a last node and symbol are equal: nothing is left to compare.
        active, known = active[known < levels], known[known < levels]


def binaries(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """values cut at bounds (in items) into an Arrow column of binaries."""
    offsets = (bounds * values.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def column_values(column: pa.Array, kind: str) -> np.ndarray:
    """The packed items of a column of binaries, one after another; null as none."""
    return np.frombuffer(b"".join(x or b"" for x in column.to_pylist()), kind)


def batched(first: np.ndarray, times: np.ndarray, weight: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Positions of whole groups (first position, size, weight), as many at a time as weigh `most`."""
    chunk = (np.cumsum(weight) - weight) // most
    for k in np.unique(chunk):
        mine = np.nonzero(chunk == k)[0]
        yield np.concatenate([np.arange(a, a + n) for a, n in zip(first[mine].tolist(), times[mine].tolist(), strict=True)])


#: Bytes of a digest that stands for a window.
DIGEST = 16
#: A row is a partition's share of what a task found: parallel arrays, packed.
SENT = "part int, settled boolean, hash binary, rid binary, start binary, count binary, offset binary, doc binary, context binary"
#: The packed columns of such a row.
PACKED = ("hash", "rid", "start", "count", "offset", "doc")
KINDS = {"hash": "<u8", "rid": "<i8", "start": "<u4", "count": "u1", "offset": "u1", "doc": "<i8", "hot": "u1"}
FIRST_ID = np.iinfo(np.int64).min


def sent(part: np.ndarray, settled: bool, columns: dict[str, np.ndarray], contexts: list[bytes] | None = None) -> pa.RecordBatch | None:
    """Rows for each partition, in the order in which the items were found."""
    if not len(part):
        return None
    order = np.argsort(part, kind="stable")
    names, first = np.unique(part[order], return_index=True)
    bounds = np.append(first, len(part))
    packed = [binaries(columns[k][order].astype(v), bounds) if k in columns else pa.array([b""] * len(names), pa.binary()) for k, v in ((x, KINDS[x]) for x in PACKED)]
    if contexts is None:
        joined = pa.array([b""] * len(names), pa.binary())
    else:
        squeeze = zstandard.ZstdCompressor(3).compress
        joined = pa.array([squeeze(b"".join([contexts[k] for k in order[a:b]])) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), pa.array([settled] * len(names)), *packed, joined], names=["part", "settled", *PACKED, "context"])


def received(batches: Iterator[pa.RecordBatch]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray], bytes]:
    """All of a partition's items: settled ones, open ones and the open ones' contexts."""
    schema = pa.schema([("part", pa.int32()), ("settled", pa.bool_()), *((k, pa.binary()) for k in (*PACKED, "context"))])
    rows = pa.Table.from_batches([x.cast(schema) for x in batches], schema)
    halves = []
    for settled in (True, False):
        some = rows.filter(pa.compute.equal(rows.column("settled"), settled))
        halves.append({k: column_values(some.column(k), KINDS[k]) for k in PACKED})
    return halves[0], halves[1], b"".join(map(zstandard.ZstdDecompressor().decompress, filter(None, some.column("context").to_pylist())))


#: Consecutive rids that share a row on the way back to their documents, as a shift.
GROUP_BITS = 6


def packed_by(key: str, names: np.ndarray, rid: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One row for each name (in column `key`) with its items packed, the rids among them."""
    order = np.lexsort((rid, names))
    kept, first = np.unique(names[order], return_index=True)
    bounds = np.append(first, len(rid))
    return pa.RecordBatch.from_arrays([pa.array(kept), *(binaries(x[order], bounds) for x in ({"rid": rid} | columns).values())], names=[key, "rid", *columns])


def by_group(rid: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    return packed_by("_group", rid >> GROUP_BITS, rid, columns)


def by_document(found: DataFrame, kinds: dict[str, str], parts: int) -> DataFrame:
    """Rows by group and sender become one row for each rid, its items packed."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            rid = np.concatenate([column_values(x.column("rid"), "<i8") for x in held])
            columns = {k: np.concatenate([column_values(x.column(k), v) for x in held]) for k, v in kinds.items()}
            made = packed_by("_rid", rid, rid, {k: v if len(v) else np.zeros(len(rid), v.dtype) for k, v in columns.items()})
            yield made.select(["_rid", *kinds])

    return found.repartition(parts, "_group").mapInArrow(releasing(gather), "_rid long, " + ", ".join(f"{k} binary" for k in kinds))


#: The database of bucketed tables. Each is dropped when its application ends; see drop_orphans.
DATABASE = "quern_work"


def stored(documents: DataFrame, buckets: int) -> DataFrame:
    """documents with a unique _rid, written once in the shared folder, bucketed by it: later joins by
    _rid then move only their other side. Buckets need a catalog entry, which is in DATABASE."""
    spark = documents.sparkSession
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {DATABASE}")
    name = f"{DATABASE}.t{uuid.uuid4().hex}"
    numbered = documents.withColumn("_rid", F.monotonically_increasing_id())
    numbered.write.option("compression", "zstd").bucketBy(buckets, "_rid").option("path", new_folder(spark, "suffix-documents")).saveAsTable(name)

    def drop() -> None:
        if spark.sparkContext._jsc is not None:
            spark.sql(f"DROP TABLE IF EXISTS {name}")

    atexit.register(drop)
    return spark.table(name)


def drop_orphans(spark: SparkSession, age: float = 7 * 86400.0) -> list[str]:
    """Drop the tables of applications that ended without dropping them: those in DATABASE that have
    stood for `age` seconds, with their files. Only a persistent catalog can have any."""
    if not spark.catalog.databaseExists(DATABASE):
        return []
    gone = []
    for table in spark.catalog.listTables(DATABASE):
        facts = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {DATABASE}.{table.name}").collect()}
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(facts["Location"])
        system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not system.exists(target) or system.getFileStatus(target).getModificationTime() / 1000 <= time.time() - age:
            spark.sql(f"DROP TABLE {DATABASE}.{table.name}")
            system.delete(target, True)
            gone.append(table.name)
    return gone


#: What is kept of a run of windows.
RUN = ("start", "count", "offset", "hash")


def repeated_anchors(documents: DataFrame, length: int, parts: int, hot: int) -> DataFrame:
    """(_group, rid, start, count, offset, hash): packed runs of windows whose anchor's hash occurs twice or more.

    Rows of _group -1 hold in `hash` the hashes that occur `hot` times or more. A task sends one item
    for each hash, with the number of its occurrences, however many it has seen.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def share() -> Iterator[pa.RecordBatch]:
            rid, start, count, offset, hashes = (np.concatenate(x) for x in zip(*held, strict=True))
            _, first, inverse, times = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
            again = times[inverse] > 1
            columns = {"rid": rid, "start": start, "count": count, "offset": offset, "hash": hashes}
            known = {k: v[again] for k, v in columns.items()}
            one = np.zeros(len(rid), bool)
            one[first] = True
            # What occurs here twice is settled and goes anywhere; its hash goes on once, marked by a count of 0.
            columns["count"] = np.where(again, 0, count)
            columns |= {"doc": times[inverse]}
            rest = {k: v[one] for k, v in columns.items()}
            for x in (sent(known["rid"] % parts, True, known), sent((rest["hash"] % np.uint64(parts)).astype(np.int64), False, rest)):
                if x is not None:
                    yield x

        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                batch = whole.slice(k, 512)
                number, start, count, offset, hashes = anchors([(x or "").encode() for x in batch.column("text").to_pylist()], length)
                held.append((batch.column("_rid").to_numpy()[number], start, count, offset, hashes))
                size += len(number)
                if size >= ANCHORS_HELD:
                    yield from share()
                    held, size = [], 0
        if size:
            yield from share()

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settled, open_, _ = received(batches)
        names, inverse, times = np.unique(open_["hash"], return_inverse=True, return_counts=True)
        again = (times[inverse] > 1) & (open_["count"] > 0)
        common = names[np.bincount(inverse, open_["doc"], len(names)) >= hot]
        if len(common):
            yield pa.RecordBatch.from_arrays([pa.array([-1]), *map(pa.array, ([b""], [b""], [b""], [b""], [common.astype("<u8").tobytes()]))], names=["_group", "rid", *RUN])
        columns = {k: np.concatenate([settled[k], open_[k][again]]) for k in ("rid", *RUN)}
        if len(columns["rid"]):
            yield by_group(columns.pop("rid"), columns)

    exchanged = documents.select("_rid", "text").mapInArrow(releasing(find), SENT).repartitionById(parts, "part")
    return exchanged.mapInArrow(releasing(match), RUNS)


RUNS = "_group long, rid binary, start binary, count binary, offset binary, hash binary"
#: Hot anchors up to which their list is broadcast (eight bytes each); more are joined to the runs.
HOT_BROADCAST = 1 << 20


def marked_hot(runs: DataFrame, hot_broadcast: int, parts: int) -> tuple[DataFrame, object | None]:
    """runs with a packed flag `hot` of each, and the hot hashes to broadcast if there are few enough
    of them (the flags are then 0). Otherwise runs are unpacked and joined to the hot hashes, where
    adaptive execution splits the runs of an anchor that fills a partition."""
    spark, listed = runs.sparkSession, runs.where("_group = -1").select("hash")
    named = runs.where("_group >= 0")
    count = listed.agg(F.sum(F.length("hash"))).first()[0] or 0
    if count // 8 <= hot_broadcast:
        found = np.frombuffer(b"".join(r["hash"] for r in listed.collect()), "<u8")
        return named.withColumn("hot", F.lit(None).cast("binary")), spark.sparkContext.broadcast(np.sort(found))

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {k: column_values(batch.column(k), KINDS[k]) for k in ("rid", *RUN)}
            yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64) if k == "hash" else v.astype(np.int64)) for k, v in columns.items()], names=list(columns))

    def repacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in (*RUN, "hot")}
                yield by_group(batch.column("rid").to_numpy(), {k: v.view(np.uint64) if k == "hash" else v.astype(KINDS[k]) for k, v in columns.items()})

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(column_values(batch.column("hash"), "<i8"))], names=["hash"])

    single = named.mapInArrow(releasing(unpacked), "rid long, start long, count long, offset long, hash long")
    often = listed.mapInArrow(releasing(hashes), "hash long").withColumn("hot", F.lit(1))
    joined = single.join(often, "hash", "left").select("rid", *RUN, F.coalesce("hot", F.lit(0)).cast("long").alias("hot"))
    return joined.mapInArrow(releasing(repacked), f"{RUNS}, hot binary"), None


def repeats(documents: DataFrame, runs: DataFrame, length: int, parts: int, hot_broadcast: int = HOT_BROADCAST) -> DataFrame:
    """(_group, rid, begin, end): packed runs of bytes covered by strings that also start earlier.

    documents: _rid, doc_id, text, bucketed into `parts` by _rid; runs: of repeated_anchors. A run's
    bytes, its context, go to the partition of its anchor, one for each task and content. Around a
    hot anchor contexts may differ at every occurrence, so there each window goes alone, as its
    128-bit digest, to the partition of the digest: no partition gathers what follows a hot passage.
    """
    named, shared = marked_hot(runs, hot_broadcast, parts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[bytes, tuple[int, int, int]] = {}
        anchor: dict[bytes, int] = {}
        later: list[tuple[int, int, int]] = []
        size = 0

        def share() -> Iterator[pa.RecordBatch]:
            contexts = list(best)
            doc, rid, start = (np.array(x, np.int64) for x in zip(*best.values(), strict=True)) if best else [np.zeros(0, np.int64)] * 3
            hashes = np.array([anchor[x] for x in contexts], np.uint64)
            columns = {"doc": doc, "rid": rid, "start": start, "count": np.array([max(0, len(x) - length + 1) for x in contexts], np.int64), "hash": hashes}
            known = dict(zip(("rid", "start", "count"), (np.array(x, np.int64) for x in zip(*later, strict=True)), strict=True)) if later else {"rid": np.zeros(0, np.int64)}
            for x in (sent(known["rid"] % parts, True, known), sent((hashes % np.uint64(parts)).astype(np.int64), False, columns, contexts)):
                if x is not None:
                    yield x

        def place(content: bytes, key: int, at: tuple[int, int, int], count: int) -> None:
            nonlocal size
            known = best.get(content)
            if known is None:
                best[content], anchor[content] = at, key
                size += len(content) + 200
            elif known <= at:
                later.append((at[1], at[2], count))
            else:
                best[content] = at
                later.append((known[1], known[2], count))

        for batch in batches:
            for row in zip(*(batch.column(k) for k in ("doc_id", "_rid", "text", "start", "count", "hash", "hot")), strict=True):
                doc_id, rid, text, *packed = (x.as_py() for x in row)
                data, doc = (text or "").encode(), FIRST_ID if doc_id is None else doc_id
                starts, counts, keys, flags = (np.frombuffer(x or b"", KINDS[k]) for k, x in zip(("start", "count", "hash", "hot"), packed, strict=True))
                spread = flags.astype(bool) if shared is None else np.isin(keys, shared.value) if len(shared.value) else np.zeros(len(keys), bool)
                for start, count, key, single in zip(starts.tolist(), counts.tolist(), keys.tolist(), spread.tolist(), strict=True):
                    if single:
                        for k in range(start, start + count):
                            digest = xxhash.xxh3_128_digest(data[k : k + length])
                            place(digest, int.from_bytes(digest[:8], "little"), (doc, rid, k), 1)
                    else:
                        place(data[start : start + count + length - 1], key, (doc, rid, start), count)
                if size + 100 * len(later) >= CONTEXT_BYTES_HELD:
                    yield from share()
                    best, anchor, later, size = {}, {}, [], 0
        if best:
            yield from share()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settled, open_, text = received(batches)
        rids, starts, ends = [settled["rid"]], [settled["start"]], [settled["start"].astype(np.int64) + settled["count"] + length - 1]
        counts = open_["count"].astype(np.int64)
        sizes = np.where(counts, counts + length - 1, DIGEST)
        begin = np.cumsum(sizes) - sizes
        order = np.lexsort((open_["start"], open_["rid"], open_["doc"]))
        seen: set[bytes] = set()
        repeated = np.zeros(len(order), bool)
        for k, a, n in zip(order.tolist(), begin[order].tolist(), sizes[order].tolist(), strict=True):
            context = text[a : a + n]
            if context in seen:
                repeated[k] = True
            else:
                seen.add(context)
        rids.append(open_["rid"][repeated])
        starts.append(open_["start"][repeated])
        ends.append(open_["start"][repeated].astype(np.int64) + np.maximum(counts[repeated], 1) + length - 1)
        # Different contexts of one anchor: their windows are sorted, the first of equal ones stays.
        place = order[~repeated[order] & (counts[order] > 0)]
        place = place[np.argsort(open_["hash"][place], kind="stable")]
        _, first, times = np.unique(open_["hash"][place], return_index=True, return_counts=True)
        weight = np.add.reduceat(sizes[place], first) if len(place) else np.zeros(0, np.int64)
        for part in batched(first[times > 1], times[times > 1], weight[times > 1], SORTED_BYTES):
            members = place[part]
            members = members[np.lexsort((open_["start"][members], open_["rid"][members], open_["doc"][members]))]
            own = counts[members]
            joined = np.frombuffer(b"".join([text[a : a + n] for a, n in zip(begin[members].tolist(), sizes[members].tolist(), strict=True)]), np.uint8)
            owner = np.repeat(np.arange(len(members)), own)
            inner = np.arange(len(owner)) - np.repeat(np.cumsum(own) - own, own)
            rank = suffix_ranks(joined, (np.cumsum(sizes[members]) - sizes[members])[owner] + inner, length)
            sort = np.argsort(rank, kind="stable")  # keeps the order of documents and starts within a rank
            second = np.zeros(len(rank), bool)
            second[sort[1:]] = rank[sort][1:] == rank[sort][:-1]
            owner, inner = owner[second], inner[second]
            new = np.ones(len(owner), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (inner[1:] != inner[:-1] + 1)
            head = np.nonzero(new)[0]
            if len(head):
                whose = members[owner[head]]
                rids.append(open_["rid"][whose])
                starts.append(open_["start"][whose] + inner[head])
                ends.append(open_["start"][whose] + inner[np.append(head[1:], len(owner)) - 1] + length)
        rid = np.concatenate(rids)
        if len(rid):
            yield by_group(rid, {"begin": np.concatenate(starts).astype("<u4"), "end": np.concatenate(ends).astype("<u4")})

    gathered = by_document(named, {k: KINDS[k] for k in ("start", "count", "hash", "hot")}, parts)
    joined = documents.select("_rid", F.col("doc_id").cast("long"), "text").join(gathered.hint("shuffle_hash"), "_rid")
    return joined.mapInArrow(releasing(cut), SENT).repartitionById(parts, "part").mapInArrow(releasing(judge), "_group long, rid binary, begin binary, end binary")


def merged(begins: bytes | None, ends: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of overlapping or touching runs."""
    if not begins:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin, end = (np.frombuffer(x, "<u4").astype(np.int64) for x in (begins, ends))
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] > reach[:-1]
    return begin[new], reach[np.append(np.nonzero(new)[0][1:] - 1, len(begin) - 1)]


def without_repeats(documents: DataFrame, length: int = 100, hot: int = 1000, hot_broadcast: int = HOT_BROADCAST) -> DataFrame:
    """documents and a struct _kept: bytes that stay, n_bytes, n_removed, n_spans.

    Texts are whole UTF-8 bytes, null as empty. A byte goes if a string of `length` bytes that covers
    it also starts earlier in the same document or anywhere in an earlier one; documents are ordered
    by doc_id, null first, rows of one id by their place in the table. An empty table gives an empty
    one. Input columns of any name are kept, but for one called _kept, which is replaced.
    Anchors that occur `hot` times or more are spread by window, whatever the size of the input, so a
    partition never holds more than that many contexts of one anchor from one task's share.
    """
    spark = documents.sparkSession
    ship(spark)
    parts = partitions_for(documents)
    others = [c for c in documents.columns if c not in ("doc_id", "text", "_kept")]
    renamed = dict(zip(others, (f"_c{k}" for k in range(len(others))), strict=True))
    rows = stored(documents.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"), *(F.col(f"`{k}`").alias(v) for k, v in renamed.items())), parts)
    # Of equal texts all but the first go whole, so only the first are searched.
    order = F.struct(F.coalesce(F.col("_id").cast("long"), F.lit(FIRST_ID)), "_rid")
    firsts = rows.groupBy(F.sha2(F.coalesce("_text", F.lit("")), 256)).agg(F.min(order)["_rid"].alias("_rid"))
    leads = staged(firsts.select("_rid"), "suffix-firsts").withColumn("_first", F.lit(True))
    searched = rows.join(leads.hint("shuffle_hash"), "_rid", "left_semi").select("_rid", F.col("_id").alias("doc_id"), F.col("_text").alias("text"))
    runs = staged(repeated_anchors(searched, length, parts, hot), "suffix-runs", arrow_rows=TEXT_ROWS)
    spans = by_document(repeats(searched, runs, length, parts, hot_broadcast), {"begin": "<u4", "end": "<u4"}, parts)
    spans = spans.select("_rid", F.col("begin").alias("_begin"), F.col("end").alias("_end"))

    def keep(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, first, begins, ends in zip(*batch, strict=True):
                data = (text or "").encode()
                begin, end = merged(begins, ends) if first else (np.zeros(1, np.int64), np.full(1, len(data)))
                if not first and len(data) < length:
                    begin = end = end[:0]
                kept = data if not len(begin) else b"".join(data[a:b] for a, b in zip([0, *end.tolist()], [*begin.tolist(), len(data)], strict=True))
                out.append((kept, len(data), len(data) - len(kept), len(begin)))
            yield pd.DataFrame(out, columns=["bytes", "n_bytes", "n_removed", "n_spans"])

    keep.__annotations__ = {"batches": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.DataFrame]}
    kept = F.pandas_udf(releasing(keep), "bytes binary, n_bytes long, n_removed long, n_spans long")
    judged = rows.join(leads.hint("shuffle_hash"), "_rid", "left").join(spans.hint("shuffle_hash"), "_rid", "left")
    first = F.coalesce("_first", F.lit(False))
    back = {"doc_id": "_id", "text": "_text"} | renamed
    return judged.withColumn("_kept", kept("_text", first, "_begin", "_end")).select(*(F.col(back[c]).alias(c) for c in documents.columns if c in back), "_kept")


def digests(documents: DataFrame, **options: int) -> DataFrame:
    done = without_repeats(documents.select("doc_id", "text"), **options)
    return done.select("doc_id", "_kept.n_bytes", "_kept.n_removed", "_kept.n_spans", F.sha2("_kept.bytes", 256).alias("kept_sha256"))


def brute_force(texts: list[bytes], length: int = 100) -> list[tuple[int, int, int, str]]:
    """The definition itself, for tests: (n_bytes, n_removed, n_spans, sha256) of texts in order."""
    seen: set[bytes] = set()
    out = []
    for data in texts:
        gone = np.zeros(len(data) + 1, bool)
        for k in range(len(data) - length + 1):
            window = data[k : k + length]
            if window in seen:
                gone[k : k + length] = True
            seen.add(window)
        spans = int((gone[:-1] & ~np.append(False, gone[:-2])).sum()) if len(data) else 0
        kept = np.frombuffer(data, np.uint8)[~gone[:-1]].tobytes()
        out.append((len(data), int(gone[:-1].sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out
