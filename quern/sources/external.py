"""Attached Parquet tables: read only, every column by its own name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.plans.scope import Field, Relation
from quern.plans.types import Family, family_of
from quern.sources.files import Files


def tables_in(spark: SparkSession, folder: str) -> dict[str, str]:
    """Paths of the Parquet tables in a folder, by name."""
    files = Files(spark, folder)
    return {x.removesuffix(".parquet"): files.path(x) for x in files.names() if x.endswith(".parquet")}


def relation(df: DataFrame, name: str) -> Relation:
    """Integers of any width become INT and floats REAL; other types can only be selected."""
    fields, columns = [], []
    for k, f in enumerate(df.schema.fields):
        family = family_of(f.dataType)
        column = df[f.name]
        columns.append((column.cast(family.value) if family in (Family.INT, Family.REAL) else column).alias(f"e{k}"))
        fields.append(Field(f.name, f"e{k}", family, name))
    return Relation(df.select(*columns), fields)
