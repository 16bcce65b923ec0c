"""Delta-maintained token counts: signed batches, committed once, add up to totals."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.bpe import ByteBpe
from quern.llm.common import SPACE, TEXT_ROWS, staged
from quern.sources.files import Files

KEYS = ("source", "lang", "tokenizer")
SUMS = ("n_docs", "n_tokens", "n_chars")
#: Layers beyond which they are summed into one.
LAYERS = 8
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_chars long"


class TokenRollup:
    """Totals by source, language and tokenizer version under `root`.

    A batch is summed by key (partly on the map side, so a hot source costs no more than others) and
    written as one small table of signed changes, a layer. A version of the state lists the batches'
    ids and the layers; it is published under the next number, which only one of racing writers can
    do, so a batch counts wholly or not at all, and a batch of an id that stands is skipped. Totals
    are sums over layers: their order is of no account, and a writer that has lost a race adds its
    layer to the state that won. Layers beyond LAYERS are summed into one, so totals never read more.

    Rows: source, lang, tokenizer, n_tokens, n_chars, one for each document; null keys are keys like
    any other, null counts are 0, repeated rows count each, other columns are not looked at. A key
    whose documents are all gone leaves the totals. An empty batch only takes its id.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root, Files(spark, root)
        self.files.make_folder()
        self.refresh()

    def refresh(self) -> None:
        """Read the latest state."""
        done = sorted(int(x) for x in self.files.names("commits") if x.isdigit())
        self.version = done[-1] if done else 0
        state = json.loads(self.files.read(f"commits/{self.version}")) if done else {"batches": [], "layers": []}
        self.batches, self.layers = set(state["batches"]), state["layers"]

    def committed(self, batch_id: str) -> bool:
        return batch_id in self.batches

    def _layer(self, changes: DataFrame) -> str:
        name = f"layers/{uuid.uuid4().hex}"
        summed = changes.groupBy(*KEYS).agg(*(F.sum(x).alias(x) for x in SUMS))
        summed.coalesce(1).write.parquet(f"{self.root}/{name}")  # one row for each key
        return name

    def commit(self, batch_id: str, inserts: DataFrame | None = None, deletes: DataFrame | None = None, revisions: tuple[DataFrame, DataFrame] | None = None) -> bool:
        """Apply inserted rows, deleted rows and revised rows (as they were, as they are); False if a
        batch of that id stands."""
        self.refresh()
        if self.committed(batch_id):
            return False
        old, new = revisions or (None, None)
        signed = self.spark.createDataFrame([], SCHEMA)
        for rows, sign in ((inserts, 1), (deletes, -1), (old, -1), (new, 1)):
            if rows is not None:
                values = [F.lit(sign).cast("long").alias("n_docs"), *((F.coalesce(x, F.lit(0)) * sign).cast("long").alias(x) for x in SUMS[1:])]
                signed = signed.union(rows.select(*KEYS, *values))
        layer = self._layer(signed)
        while True:
            layers = [*self.layers, layer]
            if len(layers) > LAYERS:
                layers = [self._layer(self._changes(layers))]
            if self.files.publish(f"commits/{self.version + 1}", json.dumps({"batches": sorted({*self.batches, batch_id}), "layers": layers})):
                self.refresh()
                return True
            self.refresh()
            if self.committed(batch_id):
                return False

    def _changes(self, layers: list[str]) -> DataFrame:
        if not layers:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*(f"{self.root}/{x}" for x in layers))

    def totals(self) -> DataFrame:
        summed = self._changes(self.layers).groupBy(*KEYS).agg(*(F.sum(x).alias(x) for x in SUMS))
        return summed.where(" or ".join(f"{x} <> 0" for x in SUMS))


def words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), ""))


def retokenized(documents: DataFrame, root: str, coder: ByteBpe) -> DataFrame:
    """Totals after all documents were loaded with counts of words, taken out again, loaded once more,
    and revised to counts of the byte-level BPE, each batch having been sent twice.

    Texts are read once: both counts of each document are written first. Null text counts 0, null
    source and lang are keys of their own, repeated rows count each, an empty table has no totals.
    """
    rollup = TokenRollup(documents.sparkSession, root)
    sizes = documents.select("source", "lang", words(F.col("text")).cast("long").alias("n_words"), coder.count(F.col("text")).alias("n_bpe"), F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"))
    sizes = staged(sizes, "rollup-sizes", arrow_rows=TEXT_ROWS)
    by_words, by_bpe = (sizes.select("source", "lang", F.lit(version).alias("tokenizer"), F.col(x).alias("n_tokens"), "n_chars") for version, x in (("words-1", "n_words"), ("byte_bpe_50k", "n_bpe")))
    for _ in range(2):
        rollup.commit("load", inserts=by_words)
        rollup.commit("unload", deletes=by_words)
        rollup.commit("load again", inserts=by_words)
        rollup.commit("revise to byte_bpe_50k", revisions=(by_words, by_bpe))
    return rollup.totals()
