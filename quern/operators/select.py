"""SELECT becomes one lazy DataFrame; Catalyst plans joins, pushdown and subqueries."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.errors import SqlError
from quern.functions.registry import AGGREGATES
from quern.operators import expressions as x
from quern.plans import nodes as n
from quern.plans.parser import parse
from quern.plans.scope import Field, Relation, Scope, fresh, same
from quern.plans.types import Typed, stored, usable

#: How deep views may stand on views.
VIEW_DEPTH = 16


class Catalog(Protocol):
    """What SELECT needs of a database."""

    spark: SparkSession

    def scan(self, name: str) -> Relation | None: ...

    def view(self, name: str) -> str | None: ...

    def function(self, name: str, schema: str | None) -> tuple[int, Callable[..., Relation]] | None: ...


class Selector:
    def __init__(self, catalog: Catalog, depth: int = 0):
        self.catalog, self.depth = catalog, depth

    # sources

    def source(self, ref: n.TableRef) -> Relation:
        found = None
        if ref.schema in (None, "main") and ref.args is None:
            text = self.catalog.view(ref.name)
            found = self.expanded(text) if text is not None else self.catalog.scan(ref.name)
        if found is None:
            found = self.called(ref)
        qualifier = ref.alias or ref.name
        names = [fresh("r") for _ in found.fields]
        df = found.df.select(*(F.col(f.internal).alias(k) for f, k in zip(found.fields, names, strict=True)))
        return Relation(df, [Field(f.name, k, f.family, qualifier, f.hidden) for f, k in zip(found.fields, names, strict=True)])

    def expanded(self, text: str) -> Relation:
        if self.depth >= VIEW_DEPTH:
            raise SqlError("InvalidViewDefinition", "views stand too deep on one another")
        return Selector(self.catalog, self.depth + 1).select(parse(text))

    def called(self, ref: n.TableRef) -> Relation:
        known = self.catalog.function(ref.name, ref.schema)
        if known is None:
            raise SqlError("TableNotFound", ref.name if ref.schema is None else f"{ref.schema}.{ref.name}")
        count, build = known
        args = ref.args or ()
        if len(args) != count:
            raise SqlError("ArgCountMismatch", ref.name)
        values = []
        for arg in args:
            sign = 1
            while isinstance(arg, n.Unary) and arg.op == "-":
                sign, arg = -sign, arg.operand
            if not isinstance(arg, n.Literal):
                raise SqlError("TypeMismatch", "arguments of table functions are literals")
            if type(arg.value) is not int:
                raise SqlError("InvalidArgumentType", ref.name)
            values.append(sign * arg.value)
        return build(*values)

    def joined(self, query: n.Select, outer: Scope | None) -> Relation:
        if query.first is None:
            return Relation(self.catalog.spark.range(1).select(), [])
        left = self.source(query.first)
        for join in query.joins:
            right = self.source(join.table)
            fields = left.fields + right.fields
            if join.kind == "cross":
                left = Relation(left.df.crossJoin(right.df), fields)
                continue
            on = x.condition(join.on, self.context(Scope(fields, outer), filtering=join.kind == "inner"))
            if join.kind == "inner":
                # A condition with a subquery can only select from the product; Catalyst moves the rest into a join.
                left = Relation(left.df.crossJoin(right.df).where(on) if has_query(join.on) else left.df.join(right.df, on, "inner"), fields)
            else:
                left = Relation(left.df.join(right.df, on, "left"), fields)
        return left

    def context(self, scope: Scope, aggregates: dict | None = None, filtering: bool = False) -> x.Context:
        return x.Context(scope, self.subquery, aggregates or {}, filtering)

    def subquery(self, query: n.Select, outer: Scope) -> Relation:
        return Selector(self.catalog, self.depth).select(query, Scope(outer.fields))

    # the query

    def select(self, query: n.Select, outer: Scope | None = None) -> Relation:
        rows = self.joined(query, outer)
        scope = Scope(rows.fields, outer)
        df = rows.df
        if query.where is not None:
            df = filtered(df, query.where, self.context(scope, filtering=True))
        wanted = [c for e in (*(i.expr for i in query.items), query.having) if e is not None for c in x.calls(e)]
        if query.group_by or wanted or query.having is not None:
            made = self.aggregated(query, Relation(df, rows.fields), scope, wanted)
        else:
            made = self.projected(query, Relation(df, rows.fields), self.context(scope))
        if query.distinct:
            made = Relation(made.df.distinct(), made.fields)
        return self.ordered(query, made) if query.order_by else made

    def aggregated(self, query: n.Select, rows: Relation, scope: Scope, wanted: list[n.Call]) -> Relation:
        keys: list[Field] = []
        for expr in query.group_by:
            if not isinstance(expr, n.Name):
                raise SqlError("TypeMismatch", "GROUP BY takes columns")
            found = scope.find(expr.name, expr.table)
            if found is None:
                raise SqlError("ColumnNotFound", expr.name)
            usable(Typed(F.col(found.internal), found.family))
            if found not in keys:
                keys.append(found)
        plain = self.context(scope)
        built = {call: x.aggregate(call, plain) for call in dict.fromkeys(wanted)}
        names = {call: fresh("a") for call in built}
        columns = [t.column.alias(names[c]) for c, t in built.items()]
        groups = [F.col(k.internal) for k in keys]
        if columns:
            df = rows.df.groupBy(*groups).agg(*columns) if keys else rows.df.select(*columns)
        elif keys:
            df = rows.df.select(*groups).distinct()
        else:
            df = rows.df.select(F.count(F.lit(1)).alias(fresh("a")))
        inner = Scope(sorted(keys, key=rows.fields.index), scope.outer)
        results = {c: Typed(F.col(names[c]), t.family) for c, t in built.items()}
        if query.having is not None:
            df = filtered(df, query.having, self.context(inner, results, filtering=True))
        return self.projected(query, Relation(df, inner.fields), self.context(inner, results))

    def projected(self, query: n.Select, rows: Relation, context: x.Context) -> Relation:
        columns, fields = [], []

        def put(value: Typed, name: str, table: str | None = None) -> None:
            value = stored(value)
            internal = fresh("o")
            columns.append(value.column.alias(internal))
            fields.append(Field(name, internal, value.family, table))

        for item in query.items:
            if isinstance(item.expr, n.Star):
                if query.first is None:
                    raise SqlError("TableNotFound", "* without FROM")
                for f in rows.visible(item.expr.table):
                    put(Typed(F.col(f.internal), f.family), f.name, f.table)
            else:
                value = x.compiled(item.expr, context)
                table = item.expr.table or next((f.table for f in rows.fields if same(f.name, item.expr.name)), None) if isinstance(item.expr, n.Name) else None
                put(value, item.alias or default_name(item.expr, context.scope), table)
        return Relation(rows.df.select(*columns), fields)

    def ordered(self, query: n.Select, made: Relation) -> Relation:
        keys = []
        for order in query.order_by:
            expr = order.expr
            if isinstance(expr, n.Literal) and type(expr.value) is int:
                if not 1 <= expr.value <= len(made.fields):
                    raise SqlError("ColumnNotFound", f"position {expr.value}")
                column = F.col(made.fields[expr.value - 1].internal)
            else:
                column = usable(stored(x.compiled(expr, self.context(Scope(made.fields))))).column
            keys.append(column.desc_nulls_last() if order.descending else column.asc_nulls_first())
        return Relation(made.df.orderBy(*keys), made.fields)


def has_query(expr: object) -> bool:
    if isinstance(expr, (n.InQuery, n.Subquery)):
        return True
    parts = vars(expr).values() if hasattr(expr, "__dataclass_fields__") else expr if isinstance(expr, tuple) else ()
    return any(has_query(p) for p in parts)


def filtered(df: DataFrame, predicate: object, context: x.Context) -> DataFrame:
    """Rows for which the predicate is true. IN with a subquery becomes a join where it stands alone
    among the conjuncts; deeper inside it is a value of three states."""
    if isinstance(predicate, n.Binary) and predicate.op == "and":
        return filtered(filtered(df, predicate.left, context), predicate.right, context)
    return df.where(x.condition(predicate, context))


def default_name(expr: object, scope: Scope) -> str:
    if isinstance(expr, n.Name):
        found = scope.find(expr.name, expr.table)
        return found.name if found else expr.name
    if isinstance(expr, n.Call):
        return expr.name.lower() if expr.name.lower() in AGGREGATES else expr.name
    return "?"
