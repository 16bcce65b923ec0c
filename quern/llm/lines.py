"""Incremental, reversible line deduplication: sharded cuckoo filters over exact reference counts."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import empty, input_bytes, releasing, ship, slices, spare
from quern.sources.files import Files

WHITE = " \t\n\x0b\x0c\r"
SLOTS = 4
KICKS = 500


def line_key(line: str) -> bytes:
    """The line without white space at its ends and with A-Z lower-cased."""
    return line.strip(WHITE).encode().lower()


def digest(key: bytes) -> bytes:
    """128 bits stand for a key in all tables."""
    return xxhash.xxh3_128_digest(key)


def as_words(digests: Iterable[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)


def line_digest(line: str, least: int) -> bytes | None:
    """The digest of a line's key, None where the key is too short to count."""
    key = line_key(line)
    return digest(key) if key and (least <= 1 or len(key.decode()) >= least) else None


class Cuckoo:
    """A cuckoo filter of 16-bit fingerprints, four to a bucket. Takes digests as rows of two words;
    the second word gives fingerprint and bucket (the first one chooses the shard)."""

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def sized(cls, keys: int) -> Cuckoo:
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, keys) / SLOTS / 0.8))))
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def loads(cls, blob: bytes) -> Cuckoo:
        return cls(np.frombuffer(blob, np.uint16).reshape(-1, SLOTS).copy())

    def dumps(self) -> bytes:
        return self.table.tobytes()

    @staticmethod
    def places(words: np.ndarray, buckets: np.ndarray | int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint and both buckets of each digest."""
        mask = np.asarray(buckets - 1).astype(np.uint64)
        prints = (words[:, 1] >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        first = words[:, 1] & mask
        return prints, first.astype(np.int64), (first ^ (Cuckoo.spread(prints) & mask)).astype(np.int64)

    @staticmethod
    def spread(prints: np.ndarray) -> np.ndarray:
        return (prints.astype(np.uint64) * np.uint64(0x5BD1E995)) & np.uint64(0x7FFFFFFF)

    def contains(self, words: np.ndarray) -> np.ndarray:
        prints, first, second = self.places(words, len(self.table))
        return (self.table[first] == prints[:, None]).any(1) | (self.table[second] == prints[:, None]).any(1)

    def insert(self, words: np.ndarray) -> bool:
        """False if the filter is too full; it must then be built anew, larger."""
        random = np.random.default_rng(3)
        for value, first, second in zip(*self.places(words, len(self.table)), strict=True):
            at = first if (self.table[first] == 0).any() else second
            for _ in range(KICKS):
                free = np.nonzero(self.table[at] == 0)[0]
                if len(free):
                    self.table[at, free[0]] = value
                    break
                slot = random.integers(SLOTS)
                value, self.table[at, slot] = self.table[at, slot], value
                at = int(at) ^ int(self.spread(np.array([value], np.uint16))[0]) & (len(self.table) - 1)
            else:
                return False
        return True

    def delete(self, words: np.ndarray) -> bool:
        """False if a digest was not in the filter."""
        for value, *buckets in zip(*self.places(words, len(self.table)), strict=True):
            for at in buckets:
                held = np.nonzero(self.table[at] == value)[0]
                if len(held):
                    self.table[at, held[0]] = 0
                    break
            else:
                return False
        return True


def shard_of(words: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each digest, of its first word taken as a signed number: see shard_column."""
    return words[:, 0].view(np.int64) % shards


def shard_column(high: str, shards: int) -> Column:
    return F.pmod(F.col(high), F.lit(shards).cast("long"))


class Probe:
    """All shards' filters and exceptions together: exact membership of common keys."""

    def __init__(self, rows: list[tuple[int, bytes, bytes]], shards: int):
        self.shards = shards
        self.base, self.size = np.zeros(shards, np.int64), np.full(shards, 1, np.int64)
        tables, at = [np.zeros((1, SLOTS), np.uint16)], 1
        for shard, blob, _ in rows:
            tables.append(np.frombuffer(blob, np.uint16).reshape(-1, SLOTS))
            self.base[shard], self.size[shard] = at, len(tables[-1])
            at += len(tables[-1])
        self.table = np.concatenate(tables)
        self.false = {x[k : k + 16] for _, _, x in rows for k in range(0, len(x), 16)}

    def common(self, digests: list[bytes]) -> np.ndarray:
        if not digests:
            return np.zeros(0, bool)
        words = as_words(digests)
        shard = shard_of(words, self.shards)
        prints, first, second = Cuckoo.places(words, self.size[shard])
        base = self.base[shard]
        held = ((self.table[base + first] == prints[:, None]) | (self.table[base + second] == prints[:, None])).any(1)
        for k in np.nonzero(held)[0]:
            held[k] = digests[k] not in self.false
        return held


#: Distinct keys that a task counts before it sends them on, and keys that a shard may have.
KEYS_HELD, SHARD_KEYS = 1 << 17, 250_000
LAYER = "high long, low long, change long"
FILTERS = "shard long, filter binary, exceptions binary, lacking long"


class LineIndex:
    """Counts in how many documents each line key stands, and drops lines whose key is common.

    The state lies under `root`. Exact reference counts are layers, tables of signed changes (the two
    halves of a key's digest, change) that add up: a commit writes only the keys of its batch, and
    takes in the newest layers that are not at least twice its size, so that there are few of them and
    a key is rewritten seldom. Beside them each shard of keys has a cuckoo filter of those in at least
    min_docs documents and its exceptions: the digests of rarer keys that the filter wrongly holds.
    Only shards that a batch touches get a new filter, changed in place where there is room. There are
    as many shards as keep each under SHARD_KEYS keys; they double as the index grows.

    A version counts once its marker is published, which only one of racing writers can do, so an
    interrupted commit changes nothing, and a batch committed before is skipped. Documents are rows:
    repeated rows count each, null text is one empty line, keys shorter than min_chars code points
    are neither counted nor dropped. Deleting takes the rows that were inserted; every later result
    is as if they had never been. An empty batch changes nothing but the list of batches.
    """

    def __init__(self, spark: SparkSession, root: str, min_docs: int = 10, min_chars: int = 1, shards: int = 8, broadcast_bytes: int = 64 << 20):
        ship(spark)
        self.spark, self.root, self.min_docs, self.min_chars, self.broadcast_bytes = spark, root, min_docs, min_chars, broadcast_bytes
        self.files = Files(spark, root)
        done = sorted(int(x) for x in self.files.names("commits") if x.isdigit())
        self.version = done[-1] if done else 0
        state = json.loads(self.files.read(f"commits/{self.version}")) if done else {"batches": [], "layers": [], "filters": None, "shards": max(1, shards)}
        self.batches: list[str] = state["batches"]
        #: (folder, rows) of each layer, the oldest first.
        self.layers: list[tuple[str, int]] = [tuple(x) for x in state["layers"]]
        self.filter_folder, self.shards = state["filters"], state["shards"]

    @staticmethod
    def shards_for(documents: DataFrame) -> int:
        """A shard for each 32 MB of input: about as many as it will need."""
        return max(8, input_bytes(documents) >> 25)

    def postings(self, documents: DataFrame, sign: int) -> DataFrame:
        """(high, low, change): documents by key, counted in each task first. Texts are taken one at a
        time; a task holds KEYS_HELD digests and those of one text."""
        least = self.min_chars

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[bytes, int] = {}

            def share() -> pa.RecordBatch:
                words = as_words(found)
                return pa.RecordBatch.from_arrays([pa.array(words[:, 0].view(np.int64)), pa.array(words[:, 1].view(np.int64)), pa.array(np.fromiter(found.values(), np.int64, len(found)) * sign)], names=["high", "low", "change"])

            for batch in batches:
                for text in batch.column("text"):
                    for key in {line_digest(x, least) for x in (text.as_py() or "").split("\n")}:
                        if key is not None:
                            found[key] = found.get(key, 0) + 1
                    if len(found) >= KEYS_HELD:
                        yield share()
                        found.clear()
            if found:
                yield share()

        return documents.select("text").mapInArrow(releasing(run), LAYER)

    def _layered(self, layers: list[tuple[str, int]]) -> DataFrame:
        if not layers:
            return empty(self.spark, LAYER)
        return self.spark.read.schema(LAYER).parquet(*(f"{self.root}/{x}" for x, _ in layers))

    def refs(self) -> DataFrame:
        """(key, n) of the latest version; key is a struct of the digest's halves."""
        summed = self._layered(self.layers)
        if len(self.layers) > 1:
            summed = summed.groupBy("high", "low").agg(F.sum("change").alias("change"))
        return summed.where("change > 0").select(F.struct("high", "low").alias("key"), F.col("change").alias("n"))

    def filters(self) -> DataFrame:
        if self.filter_folder is None:
            return empty(self.spark, FILTERS)
        return self.spark.read.schema(FILTERS).parquet(f"{self.root}/{self.filter_folder}")

    def commit(self, batch_id: str, inserts: DataFrame | None = None, deletes: DataFrame | None = None) -> bool:
        """Apply a batch; False if one of that id was committed before. ValueError if it deletes what
        was not inserted, RuntimeError if another writer has committed meanwhile."""
        if batch_id in self.batches:
            return False
        name = uuid.uuid4().hex
        batch = empty(self.spark, LAYER)
        for documents, sign in ((inserts, 1), (deletes, -1)):
            if documents is not None:
                batch = batch.union(self.postings(documents, sign))
        batch.groupBy("high", "low").agg(F.sum("change").alias("change")).where("change <> 0").write.parquet(f"{self.root}/layers/{name}")
        rows = self._layered([(f"layers/{name}", 0)]).count()
        new, known = [(f"layers/{name}", rows)] if rows else [], sum(n for _, n in self.layers) + rows
        shards, filters = self.shards, self.filter_folder
        while known > SHARD_KEYS * shards:
            shards *= 2
        if new:
            filters = f"filters/{name}"
            self._filtered(new, shards).write.parquet(f"{self.root}/{filters}")
            if deletes is not None and self.spark.read.schema(FILTERS).parquet(f"{self.root}/{filters}").where("lacking > 0").limit(1).count():
                raise ValueError(f"batch {batch_id} deletes documents that were not inserted")
        layers = self._merged([*self.layers, *new], name)
        batches, version = [*self.batches, batch_id], self.version + 1
        state = {"batches": batches, "layers": layers, "filters": filters, "shards": shards}
        if not self.files.publish(f"commits/{version}", json.dumps(state)):
            raise RuntimeError(f"version {version} was committed by another writer")
        self.version, self.batches, self.layers, self.filter_folder, self.shards = version, batches, layers, filters, shards
        return True

    def _merged(self, layers: list[tuple[str, int]], name: str) -> list[tuple[str, int]]:
        """layers with the newest ones made one while the one before is not twice as large as they are."""
        first = len(layers) - 1
        while first > 0 and layers[first - 1][1] < 2 * sum(n for _, n in layers[first:]):
            first -= 1
        if first >= len(layers) - 1:
            return layers
        folder = f"layers/{name}-merged"
        self._layered(layers[first:]).groupBy("high", "low").agg(F.sum("change").alias("change")).where("change <> 0").write.parquet(f"{self.root}/{folder}")
        return [*layers[:first], (folder, self._layered([(folder, 0)]).count())]

    def _filtered(self, new: list[tuple[str, int]], shards: int) -> DataFrame:
        """All shards' filters after the layer `new`; `lacking` counts keys that it takes below 0."""
        least = self.min_docs

        def build(old: pa.Table, rows: pa.Table) -> pa.Table:
            words = np.stack([rows.column(x).to_numpy().view(np.uint64) for x in ("high", "low")], axis=1)
            order = np.lexsort((words[:, 1], words[:, 0]))
            words = words[order]
            first = np.ones(len(words), bool)
            first[1:] = (words[1:] != words[:-1]).any(1)
            at = np.nonzero(first)[0]
            words = words[at]
            before, after = (np.add.reduceat(rows.column(x).to_numpy()[order], at) for x in ("before", "after"))
            was, now = before >= least, after >= least
            held = Cuckoo.loads(old.column("filter")[0].as_py()) if old.num_rows else None
            roomy = held is not None and now.sum() <= 0.9 * held.table.size
            if not (roomy and held.delete(words[was & ~now]) and held.insert(words[now & ~was])):
                size = int(now.sum())
                while not (held := Cuckoo.sized(size)).insert(words[now]):
                    size *= 2
            wrong = held.contains(words) & ~now & (after > 0)
            shard = int(shard_of(words[:1], shards)[0])
            return pa.table({"shard": pa.array([shard], pa.int64()), "filter": pa.array([held.dumps()], pa.binary()), "exceptions": pa.array([words[wrong].astype("<u8").tobytes()], pa.binary()), "lacking": pa.array([int((after < 0).sum())], pa.int64())})

        build.__annotations__ = {"old": pa.Table, "rows": pa.Table, "return": pa.Table}
        shard = shard_column("high", shards).alias("shard")
        changes = self._layered(new).select(shard, "high", "low", F.lit(0).cast("long").alias("before"), F.col("change").alias("after"))
        stood = self._layered(self.layers).select(shard, "high", "low", F.col("change").alias("before"), F.col("change").alias("after"))
        if not self.layers:
            everything, old = changes, empty(self.spark, FILTERS)
        elif shards != self.shards:
            everything, old = stood.union(changes), empty(self.spark, FILTERS)
        else:
            touched = changes.select("shard").distinct()
            everything, old = stood.join(touched, "shard", "left_semi").union(changes), self.filters().join(touched, "shard", "left_semi")
        made = old.groupBy("shard").cogroup(everything.groupBy("shard")).applyInArrow(build, FILTERS)
        if self.layers and shards == self.shards:
            made = made.union(self.filters().join(touched, "shard", "left_anti"))
        return made

    def drop_common(self, documents: DataFrame, committed: bool = False) -> DataFrame:
        """documents with column `text` without the lines of common keys, and columns n_lines and
        n_dropped (any of these names in the input is replaced).

        committed: every row of documents stands in the index. For such rows the filters and their
        exceptions are exact, and while they fit in broadcast_bytes each task probes them. Otherwise
        each text's keys are joined to the exact counts. Both ways give the same result. Null text is
        one empty line; an empty table gives an empty one; repeated rows are each rewritten.
        """
        if committed and 16 * self.shards <= self.broadcast_bytes:
            size = self.filters().agg(F.sum(F.length("filter") + F.length("exceptions"))).first()[0] or 0
            if size <= self.broadcast_bytes:
                found = self.filters().select("shard", "filter", "exceptions").collect()
                return self._rewritten(documents, self.spark.sparkContext.broadcast([tuple(x) for x in found]))
        return self._by_join(documents)

    def _by_join(self, documents: DataFrame) -> DataFrame:
        """The exact way: equal texts are one by their digests, their keys meet the exact counts, and
        each text gets the digests of its common keys."""
        least = self.min_chars
        print_, common = spare(documents, "print", "common")

        def keys(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            kind = pa.list_(pa.struct([("high", pa.int64()), ("low", pa.int64())]))
            for column in batches:
                for start, count in slices(column):
                    words = [as_words(sorted({line_digest(x, least) for x in (text.as_py() or "").split("\n")} - {None})).view(np.int64) for text in column.slice(start, count)]
                    yield pa.array([[{"high": a, "low": b} for a, b in x.tolist()] for x in words], kind)

        keys.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        marked = documents.withColumn(print_, F.sha2(F.coalesce("text", F.lit("")), 256))
        found = marked.select(F.col(print_).alias("print"), F.explode(F.arrow_udf(releasing(keys), "array<struct<high:long,low:long>>")("text")).alias("key")).distinct()
        often = self.refs().where(F.col("n") >= self.min_docs).select("key")
        gathered = found.join(often, "key").groupBy("print").agg(F.collect_list("key").alias(common)).withColumnRenamed("print", print_)
        return self._rewritten(marked.join(gathered, print_, "left").drop(print_), None, common)

    def _rewritten(self, documents: DataFrame, shared, common: str | None = None) -> DataFrame:
        shards, least = self.shards, self.min_chars
        (clean_,) = spare(documents, "clean")

        def clean(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            probe = Probe(shared.value, shards) if shared is not None else None
            for column, own in batches:
                for start, count in slices(column):
                    split = [(x.as_py() or "").split("\n") for x in column.slice(start, count)]
                    keys = [[line_digest(x, least) for x in lines] for lines in split]
                    if probe is None:
                        gone = [{np.array([[y["high"], y["low"]]], "<i8").tobytes() for y in x.as_py() or ()} for x in own.slice(start, count)]
                    else:
                        asked = list({k for found in keys for k in found} - {None})
                        gone = [{k for k, hit in zip(asked, probe.common(asked).tolist(), strict=True) if hit}] * count
                    kept = [[x for x, k in zip(lines, found, strict=True) if k not in out] for lines, found, out in zip(split, keys, gone, strict=True)]
                    sizes = [pa.array(x, pa.int64()) for x in (list(map(len, split)), [len(a) - len(b) for a, b in zip(split, kept, strict=True)])]
                    yield pa.StructArray.from_arrays([pa.array(["\n".join(x) for x in kept], pa.string()), *sizes], names=["text", "n_lines", "n_dropped"])

        clean.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
        own = F.lit(None).cast("int") if common is None else F.col(common)
        done = documents.withColumn(clean_, F.arrow_udf(releasing(clean), "text string, n_lines long, n_dropped long")("text", own))
        return done.withColumns({x: F.col(clean_)[x] for x in ("text", "n_lines", "n_dropped")}).drop(clean_, *([common] if common else []))


def digests(index: LineIndex, documents: DataFrame) -> DataFrame:
    """The query's columns for documents that are committed to index."""
    return index.drop_common(documents.select("doc_id", "text"), committed=True).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
