"""Names in sight: which internal column a name of the statement stands for."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.errors import SqlError
from quern.plans.types import Family, Typed

_serial = count()


@dataclass(frozen=True)
class Field:
    name: str
    internal: str
    family: Family
    table: str | None = None
    hidden: bool = False


def fresh(prefix: str) -> str:
    """A column name no other column has; joins and subqueries are then free of ambiguity."""
    return f"{prefix}{next(_serial)}"


@dataclass
class Relation:
    df: DataFrame
    fields: list[Field] = field(default_factory=list)

    def visible(self, table: str | None = None) -> list[Field]:
        if table is not None and not any(same(f.table, table) for f in self.fields):
            raise SqlError("TableNotFound", table)
        return [f for f in self.fields if not f.hidden and not f.name.startswith("__") and (table is None or same(f.table, table))]

    def named(self) -> DataFrame:
        """The result under the names the statement gives it."""
        return self.df.select(*(f.internal for f in self.fields)).toDF(*(f.name for f in self.fields))


def same(a: str | None, b: str | None) -> bool:
    return a is not None and b is not None and a.lower() == b.lower()


@dataclass
class Scope:
    """Fields of one query level. A name binds to the first field that has it; a name that this level
    lacks may bind to the level right outside."""

    fields: list[Field]
    outer: Scope | None = None

    def find(self, name: str, table: str | None) -> Field | None:
        return next((f for f in self.fields if same(f.name, name) and (table is None or same(f.table, table))), None)

    def resolve(self, name: str, table: str | None) -> Typed:
        found = self.find(name, table)
        if found:
            return Typed(F.col(found.internal), found.family)
        found = self.outer.find(name, table) if self.outer else None
        if found:
            return Typed(F.col(found.internal).outer(), found.family)
        raise SqlError("ColumnNotFound", f"{table}.{name}" if table else name)
