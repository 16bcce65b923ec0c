"""Near copies: texts whose sets of word shingles have a Jaccard similarity of a limit or more, exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.common import TEXT_ROWS, releasing, ship, staged
from quern.llm.components import components
from quern.llm.simhash import SEED, majority, near_links, row_keys

WIDTH, PERCENT = 5, 80
#: Rows of 24 bytes up to which texts are looked up by a broadcast, else by a join.
BROADCAST_ROWS = 500_000


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct XXH64 of the shingles of width words, ascending; a shorter text is one shingle."""
    words = (text or "").encode().lower().split()
    found = {xxhash.xxh64_intdigest(b" ".join(words[k : k + width]), SEED) for k in range(max(1, len(words) - width + 1))}
    return np.sort(np.fromiter(found, np.uint64, len(found)))


def shingle_sets(text: Column, width: int = WIDTH) -> Column:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([shingles(x, width).view(np.int64) for x in batch], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(releasing(run), "array<bigint>")(text)


def frequent(documents: DataFrame, width: int, sample: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a bounded sample of the texts holds more than once, ascending, and how often.
    They only shape the order of the prefixes; any order gives all pairs."""
    drawn = documents.select("text").sample(min(1.0, sample / max(1, documents.count())), seed=11).distinct()
    counts = drawn.select(F.explode(shingle_sets(F.col("text"), width)).alias("gram")).groupBy("gram").count().where("count > 1")
    found = counts.orderBy(F.desc("count")).limit(most).toPandas()
    grams = found["gram"].to_numpy(np.int64).view(np.uint64)
    place = np.argsort(grams)
    return grams[place], found["count"].to_numpy(np.int64)[place]


#: 64-bit words of a set's parity sketch.
SKETCH = ("s0", "s1", "s2", "s3")


def sketch(grams: np.ndarray, classes: int = 256) -> np.ndarray:
    """A bit for each of 256 classes of shingles (or another power of two): whether the set has an odd
    number of them. Every shingle that only one of two sets has turns one bit, so the sketches of two
    sets differ in no more bits than the sets in shingles. The exclusive or of a sketch's halves is the
    sketch of half as many classes."""
    odd = np.bincount((grams >> np.uint64(20)).astype(np.int64) & (classes - 1), minlength=classes) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def wide_sketch(grams: np.ndarray) -> np.ndarray:
    """The sketch of at least two classes for each shingle, which does not fill up with the set."""
    return sketch(grams, max(256, 1 << (2 * len(grams) - 1).bit_length()))


def differing(a: Column, b: Column) -> Column:
    """Bits in which two wide sketches differ, the longer one folded to the classes of the other. Of
    sketches that lie a factor of more than two apart the sets are not half alike; these are null."""
    size = F.least(F.size(a), F.size(b))

    def folded(x: Column) -> Column:
        return F.when(F.size(x) > size, F.transform(F.slice(x, F.lit(1), size), lambda v, k: v.bitwiseXOR(F.get(x, k + size)))).otherwise(x)

    bits = F.aggregate(F.zip_with(folded(a), folded(b), lambda v, w: F.bit_count(v.bitwiseXOR(w))), F.lit(0), lambda total, v: total + v)
    return F.when(F.greatest(F.size(a), F.size(b)) <= 2 * size, bits)


def prefixes(text: Column, order, width: int, percent: int) -> Column:
    """A struct of node (a hash of the set), n (its size), fp (its SimHash fingerprint), its sketches
    and prefix: its rarest shingles, so many that two sets of at least percent similarity have one of
    them in common."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known, counts = order.value
        for batch in batches:
            rows = []
            for x in batch:
                grams = shingles(x, width)
                n = len(grams)
                rank = np.zeros(n, np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
                    rank = np.where(known[at] == grams, counts[at], 0)
                first = grams[np.argsort(rank, kind="stable")][: n - -(-percent * n // 100) + 1]
                rows.append((np.uint64(xxhash.xxh64_intdigest(grams.tobytes(), SEED)).astype(np.int64), n, np.uint64(majority(grams)).astype(np.int64), *sketch(grams), wide_sketch(grams), first.view(np.int64)))
            yield pd.DataFrame(rows, columns=["node", "n", "fp", *SKETCH, "wide", "prefix"])

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(releasing(run), "node bigint, n bigint, fp bigint, s0 bigint, s1 bigint, s2 bigint, s3 bigint, wide array<bigint>, prefix array<bigint>")(text)


def near_copies(documents: DataFrame, width: int = WIDTH, percent: int = PERCENT, radius: int = 3, sample: int = 5_000, most: int = 200_000) -> DataFrame:
    """doc_id and row keys of every row of documents, and `component`: rows are linked if the Jaccard
    similarity of their texts' shingles is percent / 100 or more.

    Texts of equal sets are one node. First SimHash: nodes whose fingerprints the vantage trees join
    over links of at most radius bits are a group, and each is compared with the group's first by the
    whole sets. Similar texts may differ in more bits than any radius finds, so an exact way for the
    rest follows: sets are ordered from rare to frequent shingles, and two similar ones share one of
    their first n - ceil(percent * n / 100) + 1. Of those that share one and are not yet in one
    component all are first compared with one of them. Of what is then still apart only pairs meet
    that sizes, places of the shingle and sketches allow to be similar; so no similar pair is lost.
    Texts without words, null ones too, are copies of each other; repeated rows and those of null id
    are nodes' rows like any others; an empty table gives an empty result. Only doc_id and text are
    read.
    """
    spark = documents.sparkSession
    ship(spark)
    order = spark.sparkContext.broadcast(frequent(documents, width, sample, most))
    keys = row_keys()
    marked = staged(documents.select("doc_id", *(c.alias(k) for k, c in keys.items()), prefixes(F.col("text"), order, width, percent).alias("s")).select("doc_id", *keys, "s.*"), "jaccard-prefixes", arrow_rows=TEXT_ROWS)
    nodes = staged(marked.groupBy("node").agg(F.min(F.struct(*keys)).alias("row"), *(F.first(x).alias(x) for x in ("n", "fp", *SKETCH, "wide"))), "jaccard-nodes")

    def enough(common: Column, a: Column, b: Column) -> Column:
        return (100 + percent) * common >= percent * (a + b)

    def few(bits: Column, a: Column, b: Column) -> Column:
        """Whether sets of a and b shingles may be similar if their sketches differ in so many bits:
        similar ones differ in few shingles, so their sketches differ in as few bits at most."""
        return (100 + percent) * bits <= (100 - percent) * (a + b)

    def open_(a: str, b: str) -> Column:
        """Whether two sets may be similar whose first common shingle is this row's: what they share
        lies in what is left of both from there on. Later common shingles leave less, so a pair that
        no row keeps is not similar."""
        left, right = (F.col(f"{a}rest"), F.col(f"{a}n")), (F.col(f"{b}rest"), F.col(f"{b}n"))
        return enough(F.least(left[0], right[0]), left[1], right[1])

    def links(met: DataFrame) -> DataFrame:
        """The pairs (a, b) of met that are similar: those whose wide sketches allow it are compared
        by their whole sets, which so travel for hardly a pair in vain."""
        left, right = (nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("wide").alias(f"wide_{x}")) for x in "ab")
        tried = staged(met.distinct().join(left, "a").join(right, "b").where(few(differing(F.col("wide_a"), F.col("wide_b")), F.col("n_a"), F.col("n_b"))).select("a", "b"), "jaccard-pairs")
        wanted = staged(nodes.select("node", "row.*").join(tried.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi"), "jaccard-wanted")
        found = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
        sets = documents.select("text", *(c.alias(k) for k, c in keys.items())).join(found, list(keys)).dropDuplicates(["node"]).select("node", shingle_sets(F.col("text"), width).alias("set"))
        sets = staged(sets, "jaccard-sets", arrow_rows=TEXT_ROWS)
        left, right = (sets.select(F.col("node").alias(x), F.col("set").alias(f"set_{x}")) for x in "ab")
        both = tried.join(left, "a").join(right, "b")
        return staged(both.where(enough(F.size(F.array_intersect("set_a", "set_b")), F.size("set_a"), F.size("set_b"))).select("a", "b"), "jaccard-links")

    def apart(pairs: DataFrame, member: DataFrame) -> DataFrame:
        """The pairs (a, b) that are not in one component."""
        for x in "ab":
            pairs = pairs.join(member.select(F.col("node").alias(x), F.col("component").alias(f"part_{x}")), x, "left")
        return pairs.where(F.coalesce("part_a", "a") != F.coalesce("part_b", "b")).select("a", "b")

    prints = nodes.select("fp").distinct()
    close = components(near_links(prints.select("fp", F.col("fp").alias("node")), radius)).select(F.col("node").alias("fp"), "component")
    grouped = nodes.select("node", "fp").join(close, "fp", "left").select("node", F.coalesce("component", "fp").alias("group"))
    first = grouped.groupBy("group").agg(F.min("node").alias("b"), F.max("node").alias("last")).where("b < last").drop("last")
    linked = links(grouped.join(first, "group").where("node <> b").select(F.col("node").alias("a"), "b"))

    gram = Window.partitionBy("gram")
    placed = marked.groupBy("node").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix")).select("node", "n", F.posexplode("prefix").alias("at", "gram")).select("gram", "node", "n", (F.col("n") - F.col("at")).alias("rest"))
    led = placed.withColumns({"lead": F.min(F.struct("node", "n", "rest")).over(gram), "last": F.max("node").over(gram)})
    shared = staged(led.where(F.col("lead.node") < F.col("last")).drop("last"), "jaccard-shared")
    star = shared.where((F.col("node") != F.col("lead.node")) & open_("", "lead.")).select(F.col("node").alias("a"), F.col("lead.node").alias("b")).distinct()
    linked = linked.union(links(apart(star, components(linked))))

    part = shared.drop("lead").join(components(linked).withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select("gram", "node", "n", "rest", F.coalesce("component", "node").alias("part"))
    split = part.withColumns({"_least": F.min("part").over(gram), "_most": F.max("part").over(gram)}).where("_least < _most").drop("_least", "_most")
    part = staged(split.join(nodes.select("node", *SKETCH), "node"), "jaccard-parts")
    x, y = (part.select("gram", *(F.col(c).alias(f"{side}_{c}") for c in ("node", "n", "rest", "part", *SKETCH))) for side in "xy")
    bits = sum(F.bit_count(F.col(f"x_{k}").bitwiseXOR(F.col(f"y_{k}"))) for k in SKETCH)
    crossing = x.join(y, "gram").where((F.col("x_node") < F.col("y_node")) & (F.col("x_part") != F.col("y_part")) & open_("x_", "y_") & few(bits, F.col("x_n"), F.col("y_n")))
    member = components(linked.union(links(crossing.select(F.col("x_node").alias("a"), F.col("y_node").alias("b")))))
    found = marked.select("doc_id", *keys, "node").join(member.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
    return found.select("doc_id", *keys, F.coalesce("component", "node").alias("component"))
