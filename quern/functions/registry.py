"""Scalar and aggregate functions by name: how many arguments, and how to build the Column."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import functions as F

from quern.errors import SqlError
from quern.plans.types import NUMERIC, Family, Typed, cast, null, stored, unified


@dataclass(frozen=True)
class Scalar:
    least: int
    most: int | None
    build: Callable[[list[Typed]], Typed]


@dataclass(frozen=True)
class Aggregate:
    build: Callable[[Typed, bool], Typed]


def _abs(args: list[Typed]) -> Typed:
    value = stored(args[0])
    if value.family not in (Family.INT, Family.REAL, Family.NULL):
        raise SqlError("TypeMismatch", "abs of a value that is not a number")
    return Typed(F.abs(value.column) if value.family is not Family.NULL else null(Family.INT), value.family)


def _nullif(args: list[Typed]) -> Typed:
    a, b = map(stored, args)
    if Family.NULL in (a.family, b.family):
        return a
    if a.family in NUMERIC and b.family in NUMERIC:
        shared = unified([a.family, b.family])
        return Typed(F.when(cast(a, shared) == cast(b, shared), F.lit(None)).otherwise(a.column), a.family)
    return Typed(F.when(a.column == b.column, F.lit(None)).otherwise(a.column), a.family) if a.family is b.family else a


def _coalesce(args: list[Typed]) -> Typed:
    shared = unified([x.family for x in args])
    return Typed(F.coalesce(*(cast(x, shared) for x in args)), shared)


SCALARS = {"abs": Scalar(1, 1, _abs), "nullif": Scalar(2, 2, _nullif), "coalesce": Scalar(1, None, _coalesce)}


def _number(value: Typed) -> Typed:
    value = stored(value)
    if value.family is Family.NULL:
        return Typed(null(Family.INT), Family.INT)
    if value.family not in (Family.INT, Family.REAL):
        raise SqlError("TypeMismatch", "an aggregate of values that are not numbers")
    return value


def _count(value: Typed, distinct: bool) -> Typed:
    return Typed(F.count_distinct(value.column) if distinct else F.count(value.column), Family.INT)


def _sum(value: Typed, distinct: bool) -> Typed:
    value = _number(value)
    return Typed(F.sum_distinct(value.column) if distinct else F.sum(value.column), value.family)


def _avg(value: Typed, distinct: bool) -> Typed:
    value = _number(value)
    if distinct:
        return Typed(F.sum_distinct(value.column).cast("double") / F.nullif(F.count_distinct(value.column).cast("double"), F.lit(0.0)), Family.REAL)
    return Typed(F.avg(value.column), Family.REAL)


def _extreme(build: Callable) -> Callable[[Typed, bool], Typed]:
    def made(value: Typed, distinct: bool) -> Typed:
        value = value if value.family is Family.TEXT else _number(value)
        return Typed(build(value.column), value.family)

    return made


AGGREGATES = {"count": Aggregate(_count), "sum": Aggregate(_sum), "avg": Aggregate(_avg), "min": Aggregate(_extreme(F.min)), "max": Aggregate(_extreme(F.max))}


def scalar(name: str, args: list[Typed]) -> Typed:
    known = SCALARS.get(name.lower())
    if known is None:
        raise SqlError("UnknownFunction", name)
    if len(args) < known.least or (known.most is not None and len(args) > known.most):
        raise SqlError("WrongArgCount", name)
    return known.build(args)
