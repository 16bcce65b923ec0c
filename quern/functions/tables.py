"""Table functions and the tables that describe the database."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.plans.scope import Field, Relation
from quern.plans.types import Family
from quern.sources.store import ROWID, Store, page_number

TABLES = (("table_schema", "string"), ("table_name", "string"), ("btree_root", "bigint"), ("column_count", "bigint"))
COLUMNS = (
    ("TABLE_CATALOG", "string"), ("TABLE_SCHEMA", "string"), ("TABLE_NAME", "string"), ("COLUMN_NAME", "string"),
    ("ORDINAL_POSITION", "bigint"), ("COLUMN_DEFAULT", "string"), ("IS_NULLABLE", "string"), ("DATA_TYPE", "string"),
)
FAMILIES = {"string": Family.TEXT, "bigint": Family.INT}


def _described(df: DataFrame, columns: tuple[tuple[str, str], ...]) -> Relation:
    return Relation(df, [Field(name, name, FAMILIES[kind]) for name, kind in columns])


def functions(store: Store) -> dict[tuple[str | None, str], tuple[int, Callable[..., Relation]]]:
    """(number of arguments, builder) by schema and name; None stands for the main schema."""
    spark = store.spark

    def rows(values: list[tuple], columns: tuple[tuple[str, str], ...]) -> Relation:
        return _described(spark.createDataFrame(values, ", ".join(f"{name} {kind}" for name, kind in columns)), columns)

    def series(end: int) -> Relation:
        """0 up to end, end itself left out."""
        return _described(spark.range(max(0, end)).select(F.col("id").alias("generate_series")), (("generate_series", "bigint"),))

    def tables() -> Relation:
        return rows([("main", name, t.id, len(t.columns)) for name, t in store.current.tables.items()], TABLES)

    def columns() -> Relation:
        found = [("def", "main", name, c.name, k, c.default_source, "YES" if c.nullable else "NO", c.type) for name, t in store.current.tables.items() for k, c in enumerate(t.columns)]
        return rows(found, COLUMNS)

    def files() -> DataFrame | None:
        parts = [store.read(t).select(page_number().alias("page"), F.col("_metadata.row_index").alias("slot"), F.col(ROWID).alias("rowid"), F.octet_length(F.to_json(F.struct(*(f"c{k}" for k in range(len(t.columns)))))).cast("bigint").alias("size")) for t in store.current.tables.values() if t.folders]
        df = None
        for part in parts:
            df = part if df is None else df.union(part)
        return df

    def pages() -> Relation:
        """Page 0 is the manifest; every data file with rows is a leaf."""
        shape = (("page_id", "bigint"), ("page_type", "string"))
        header, found = spark.createDataFrame([(0, "header")], "page_id bigint, page_type string"), files()
        return _described(header if found is None else header.union(found.select("page").distinct().select("page", F.lit("btree_leaf"))), shape)

    def slots(page: int) -> Relation:
        """The rows of one data file; data_len is the length of a row as JSON."""
        shape = (("slot_idx", "bigint"), ("rowid", "bigint"), ("data_len", "bigint"), ("is_overflow", "bigint"))
        found = files()
        if found is None:
            return rows([], shape)
        return _described(found.where(F.col("page") == page).select(F.col("slot").alias("slot_idx"), "rowid", F.col("size").alias("data_len"), F.lit(0).cast("bigint").alias("is_overflow")), shape)

    return {
        (None, "generate_series"): (1, series),
        ("information_schema", "tables"): (0, tables),
        ("information_schema", "columns"): (0, columns),
        (None, "__pages"): (0, pages),
        (None, "__page_slots"): (1, slots),
    }
