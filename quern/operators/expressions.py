"""Expressions become Columns with a family. All typing is done here, before Catalyst sees anything."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.errors import SqlError
from quern.functions.registry import AGGREGATES, scalar
from quern.plans import nodes as n
from quern.plans.scope import Relation, Scope
from quern.plans.types import NUMBER, NUMERIC, Family, Typed, cast, null, stored, truth, unified, usable


@dataclass
class Context:
    """What an expression may refer to. `aggregates` maps calls that are computed already to their
    columns; `filtering` is true where a condition selects rows, so that subqueries can be joins."""

    scope: Scope
    subquery: Callable[[n.Select, Scope], Relation]
    aggregates: dict[n.Call, Typed] = field(default_factory=dict)
    filtering: bool = False

    def inside(self) -> Context:
        return Context(self.scope, self.subquery, self.aggregates)


def literal(value: int | float | str | bool | None) -> Typed:
    if value is None:
        return Typed(F.lit(None), Family.NULL)
    if isinstance(value, bool):
        return Typed(F.lit(value), Family.BOOL)
    if isinstance(value, int):
        return Typed(F.lit(value).cast("bigint"), Family.INT)
    return Typed(F.lit(value), Family.REAL if isinstance(value, float) else Family.TEXT)


def compiled(expr: object, context: Context) -> Typed:
    if isinstance(expr, n.Call) and expr in context.aggregates:
        return context.aggregates[expr]
    return RULES[type(expr)](expr, context)


def operand(expr: object, context: Context) -> Typed:
    return usable(compiled(expr, context.inside()))


def condition(expr: object, context: Context) -> Column:
    return truth(usable(compiled(expr, context)))


def _name(expr: n.Name, context: Context) -> Typed:
    return context.scope.resolve(expr.name, expr.table)


def _star(expr: n.Star, context: Context) -> Typed:
    raise SqlError("WildcardInExpression")


def _unary(expr: n.Unary, context: Context) -> Typed:
    if expr.op == "not":
        value = usable(compiled(expr.operand, context))
        if value.family not in (Family.BOOL, Family.NULL):
            raise SqlError("TypeMismatch", "NOT of a value that is not a truth value")
        return Typed(~truth(value), Family.BOOL)
    if isinstance(expr.operand, n.Literal) and type(expr.operand.value) in (int, float):
        return literal(-expr.operand.value)
    value = stored(operand(expr.operand, context))
    if value.family not in (Family.INT, Family.REAL, Family.NULL):
        raise SqlError("TypeMismatch", "minus of a value that is not a number")
    return Typed(-cast(value, Family.INT) if value.family is Family.NULL else -value.column, value.family)


def _binary(expr: n.Binary, context: Context) -> Typed:
    if expr.op in ("and", "or"):
        left, right = condition(expr.left, context), condition(expr.right, context)
        return Typed(left & right if expr.op == "and" else left | right, Family.BOOL)
    left, right = operand(expr.left, context), operand(expr.right, context)
    return arithmetic(expr.op, left, right) if expr.op in "+-*/" else Typed(compare(expr.op, left, right), Family.BOOL)


def arithmetic(op: str, left: Typed, right: Typed) -> Typed:
    left, right = stored(left), stored(right)
    if not {left.family, right.family} <= {Family.INT, Family.REAL, Family.NULL}:
        raise SqlError("TypeMismatch", f"{op} of values that are not numbers")
    family = unified([left.family, right.family])
    if Family.NULL in (left.family, right.family):
        family = Family.INT if family is Family.NULL else family
        return Typed(null(family), family)
    a, b = cast(left, family), cast(right, family)
    if op == "/":
        if family is Family.INT:
            return Typed(F.call_function("div", a, F.nullif(b, F.lit(0).cast("bigint"))), family)
        return Typed(a / F.nullif(b, F.lit(0.0)), family)
    return Typed({"+": a + b, "-": a - b, "*": a * b}[op] if op != "-" else a - b, family)


COMPARISONS = {"=": Column.__eq__, "<>": Column.__ne__, "<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__}


def compare(op: str, left: Typed, right: Typed) -> Column:
    """Numbers compare as numbers and texts as bytes. Values of different families are never equal,
    and each counts as less than the other."""
    if Family.NULL in (left.family, right.family):
        return F.lit(None).cast("boolean")
    if left.family in NUMERIC and right.family in NUMERIC:
        left, right = stored(left), stored(right)
        shared = unified([left.family, right.family])
        return COMPARISONS[op](cast(left, shared), cast(right, shared))
    if left.family is right.family:
        return COMPARISONS[op](left.column, right.column)
    return F.when(left.column.isNull() | right.column.isNull(), F.lit(None).cast("boolean")).otherwise(F.lit(op in ("<>", "<", "<=")))


def _is_null(expr: n.IsNull, context: Context) -> Typed:
    value = compiled(expr.operand, context.inside()).column
    return Typed(value.isNotNull() if expr.negated else value.isNull(), Family.BOOL)


def _between(expr: n.Between, context: Context) -> Typed:
    value, low, high = (operand(x, context) for x in (expr.operand, expr.low, expr.high))
    if expr.negated:
        return Typed(compare("<", value, low) | compare(">", value, high), Family.BOOL)
    return Typed(compare(">=", value, low) & compare("<=", value, high), Family.BOOL)


def _in_list(expr: n.InList, context: Context) -> Typed:
    value = operand(expr.operand, context)
    items = [operand(x, context) for x in expr.items]
    numbers = [x for x in items if x.family is not Family.NULL]
    if items and len(numbers) == len(items) and value.family is not Family.NULL and len({stored(x).family for x in [value, *items]}) == 1:
        found = stored(value).column.isin(*(stored(x).column for x in items))
    else:
        found = F.lit(False)
        for x in items:
            found = found | compare("=", value, x)
    found = F.when(value.column.isNull(), F.lit(None).cast("boolean")).otherwise(found) if not items or len(numbers) < len(items) or value.family is Family.NULL else found
    return Typed(~found if expr.negated else found, Family.BOOL)


def _in_query(expr: n.InQuery, context: Context) -> Typed:
    value = stored(operand(expr.operand, context))
    inner = context.subquery(expr.query, context.scope)
    item = stored(usable(Typed(F.col(inner.fields[0].internal), inner.fields[0].family)))
    if Family.NULL not in (value.family, item.family) and value.family is not item.family and not (value.family in NUMERIC and item.family in NUMERIC):
        # Values of these families are never equal: the set is searched in vain.
        item, value = Typed(F.when(item.column.isNull(), null(Family.INT)).otherwise(F.lit(0).cast("bigint")), Family.INT), Typed(F.when(value.column.isNotNull(), F.lit(1).cast("bigint")), Family.INT)
    shared = unified([value.family, item.family])
    shared = Family.INT if shared is Family.NULL else shared
    column, rows = cast(value, shared), inner.df.select(cast(item, shared).alias(inner.fields[0].internal))
    name = inner.fields[0].internal
    if context.filtering and expr.negated and not _can_be_broadcast(rows):
        # Catalyst's null-aware anti join sends the whole set to every task, however large it is. This
        # says the same by a plain anti join and one row about the set's nulls.
        about = rows.select(F.struct(F.count(F.lit(1)).alias("n"), F.count_if(F.col(name).isNull()).alias("nulls"))).scalar()
        match = rows.where(F.col(name) == _seen_from_inside(column)).exists()
        return Typed(~match & (about["nulls"] == 0) & (column.isNotNull() | (about["n"] == 0)), Family.BOOL)
    if context.filtering:
        found = column.isin(rows)
        return Typed(~found if expr.negated else found, Family.BOOL)
    # Where no row is selected by it, IN must be null, not false, when a null leaves it open.
    matches = rows.where(F.col(name) == _seen_from_inside(column)).select(F.count(F.lit(1))).scalar()
    nulls = rows.where(F.col(name).isNull()).select(F.count(F.lit(1))).scalar()
    unknown = F.lit(None).cast("boolean")
    found = F.when(column.isNull(), unknown).when(F.coalesce(matches, F.lit(0)) > 0, F.lit(True)).when(F.coalesce(nulls, F.lit(0)) > 0, unknown).otherwise(F.lit(False))
    return Typed(~found if expr.negated else found, Family.BOOL)


def _can_be_broadcast(rows: DataFrame) -> bool:
    """Whether Catalyst expects rows to stay under the session's limit for broadcasts. A set that
    depends on the outer row has no plan of its own; it is joined by what it depends on."""
    try:
        plan = rows._jdf.queryExecution()
        size, limit = plan.optimizedPlan().stats().sizeInBytes(), plan.sparkSession().sessionState().conf().autoBroadcastJoinThreshold()
    except (AnalysisException, Py4JJavaError):
        return True
    return int(str(size)) <= int(limit)


def _seen_from_inside(column: Column) -> Column:
    return column.outer()


def _case(expr: n.Case, context: Context) -> Typed:
    inner = context.inside()
    if expr.operand is None:
        conditions = [condition(c, inner) for c, _ in expr.branches]
    else:
        value = operand(expr.operand, context)
        conditions = [compare("=", value, operand(c, context)) for c, _ in expr.branches]
    results = [operand(r, context) for _, r in expr.branches]
    otherwise = operand(expr.otherwise, context) if expr.otherwise is not None else literal(None)
    shared = unified([x.family for x in [*results, otherwise]])
    built = None
    for c, r in zip(conditions, results, strict=True):
        built = F.when(c, cast(r, shared)) if built is None else built.when(c, cast(r, shared))
    return Typed(built.otherwise(cast(otherwise, shared)), shared)


def _cast(expr: n.Cast, context: Context) -> Typed:
    value, target = operand(expr.operand, context), Family[expr.target]
    if isinstance(expr.operand, n.Literal) and isinstance(expr.operand.value, str) and target in (Family.INT, Family.REAL):
        if not re.fullmatch(NUMBER[target], expr.operand.value):
            raise SqlError("TypeMismatch", f"{expr.operand.value!r} is no {expr.target}")
    return Typed(cast(value, target), target)


def _call(expr: n.Call, context: Context) -> Typed:
    if expr.name.lower() in AGGREGATES or expr.distinct:
        raise SqlError("UnknownFunction", expr.name)
    return scalar(expr.name, [operand(x, context) for x in expr.args])


def _subquery(expr: n.Subquery, context: Context) -> Typed:
    inner = context.subquery(expr.query, context.scope)
    first = inner.fields[0]
    rows = inner.df.select(first.internal)
    return Typed((rows if _one_row(expr.query) else rows.limit(1)).scalar(), first.family)


def _one_row(query: n.Select) -> bool:
    """Whether a query is sure to give one row, so that it needs no limit."""
    return not query.group_by and query.having is None and any(calls(x.expr) for x in query.items)


def calls(expr: object) -> list[n.Call]:
    """Aggregate calls in an expression, those of its subqueries left out."""
    if isinstance(expr, n.Call):
        if expr.name.lower() in AGGREGATES:
            return [expr]
        return [c for x in expr.args for c in calls(x)]
    if isinstance(expr, (n.Unary, n.IsNull, n.Cast, n.InQuery)):
        return calls(expr.operand)
    if isinstance(expr, n.Binary):
        return calls(expr.left) + calls(expr.right)
    if isinstance(expr, n.Between):
        return calls(expr.operand) + calls(expr.low) + calls(expr.high)
    if isinstance(expr, n.InList):
        return [c for x in (expr.operand, *expr.items) for c in calls(x)]
    if isinstance(expr, n.Case):
        return [c for x in (expr.operand, *(y for b in expr.branches for y in b), expr.otherwise) for c in calls(x)]
    return []


def aggregate(call: n.Call, context: Context) -> Typed:
    """The column of one aggregate call over the rows in scope."""
    build = AGGREGATES[call.name.lower()].build
    starred = call.args in ((), (n.Star(),))
    if starred and call.name.lower() == "count" and not call.distinct:
        return Typed(F.count(F.lit(1)), Family.INT)
    if len(call.args) != 1 or starred:
        raise SqlError("WrongArgCount", call.name)
    if calls(call.args[0]):
        raise SqlError("UnknownFunction", "an aggregate inside an aggregate")
    return build(stored(operand(call.args[0], context)), call.distinct)


RULES = {
    n.Literal: lambda e, c: literal(e.value),
    n.Name: _name,
    n.Star: _star,
    n.Unary: _unary,
    n.Binary: _binary,
    n.IsNull: _is_null,
    n.Between: _between,
    n.InList: _in_list,
    n.InQuery: _in_query,
    n.Case: _case,
    n.Cast: _cast,
    n.Call: _call,
    n.Subquery: _subquery,
}
