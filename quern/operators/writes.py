"""INSERT, UPDATE and DELETE write new folders; CREATE INDEX clusters a table's data."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from quern.errors import SqlError
from quern.operators import expressions as x
from quern.operators.select import Selector, filtered, has_query
from quern.plans import nodes as n
from quern.plans.parser import parse_expression
from quern.plans.scope import Field, Scope
from quern.plans.types import Family, Typed, cast, null, stored, usable
from quern.sources.store import FOLDERS, ROWID, ColumnInfo, IndexInfo, Store, TableInfo

#: Plans that Catalyst expects to stay under this size are written by one task, as one file.
SMALL = 32 << 20


def coerced(value: Typed, column: ColumnInfo) -> Column:
    """A value as a table stores it: whole numbers widen to REAL, text goes into BLOB, nothing else changes family."""
    value, target = stored(usable(value)), Family[column.type]
    if value.family is Family.NULL:
        return null(target)
    if value.family is target or (value.family, target) in ((Family.INT, Family.REAL), (Family.TEXT, Family.BLOB)):
        return cast(value, target)
    raise SqlError("TypeMismatch", f"{value.family.name} for column {column.name} of type {column.type}")


class Writer:
    def __init__(self, store: Store, selector: Selector):
        self.store, self.selector = store, selector

    # insert

    def insert(self, statement: n.Insert) -> int:
        info = self.store.table(statement.table)
        if statement.columns is not None:
            places = [info.position(c) for c in statement.columns]
            if len(set(places)) < len(places):
                raise SqlError("ColumnCountMismatch", "a column is named twice")
        else:
            places = list(range(len(info.columns)))
        if statement.rows is not None:
            return self.append(statement.table, info, self.listed(statement.rows, info, places, statement.columns is not None), ordered=True)
        df, given = self.queried(statement.query, info, places, statement.columns is not None)
        return self.append(statement.table, info, df, ordered=False, keyed=info.key in given)

    def context(self, scope: Scope | None = None, filtering: bool = False) -> x.Context:
        return self.selector.context(scope or Scope([]), filtering=filtering)

    def default(self, column: ColumnInfo, omitted: bool = True) -> Column:
        if column.default_source is not None:
            return coerced(x.compiled(parse_expression(column.default_source), self.context()), column)
        if omitted and not column.nullable and not column.primary_key:
            raise SqlError("NoDefaultValue", column.name)
        return null(Family[column.type])

    def listed(self, rows: tuple, info: TableInfo, places: list[int], named: bool) -> DataFrame:
        built = []
        for row in rows:
            if len(row) > len(places) or (named and len(row) != len(places)):
                raise SqlError("ColumnCountMismatch", f"{len(row)} values for {len(places)} columns")
            given = {}
            for place, value in zip(places, row, strict=False):
                column = info.columns[place]
                given[place] = self.default(column) if isinstance(value, n.Default) else coerced(x.compiled(value, self.context()), column)
            values = [given[k] if k in given else self.default(c) for k, c in enumerate(info.columns)]
            built.append(F.struct(*(v.alias(f"c{k}") for k, v in enumerate(values))))
        one = self.store.spark.range(1)
        if any(has_query(r) for r in rows):
            # Subqueries can't stand inside a generator: each row is a projection of its own.
            parts = [one.select(F.lit(k).alias("__pos"), *(b[f"c{i}"].alias(f"c{i}") for i in range(len(info.columns)))) for k, b in enumerate(built)]
            df = parts[0]
            for part in parts[1:]:
                df = df.union(part)
            return df
        return one.select(F.posexplode(F.array(*built)).alias("__pos", "__row")).select("__pos", "__row.*")

    def queried(self, query: n.Select, info: TableInfo, places: list[int], named: bool) -> tuple[DataFrame, set[int]]:
        """The rows to insert, and the places that the query gives values for."""
        found = self.selector.select(query)
        if len(found.fields) > len(places) or (named and len(found.fields) != len(places)):
            raise SqlError("ColumnCountMismatch", f"{len(found.fields)} columns for {len(places)}")
        given = {place: coerced(Typed(F.col(f.internal), f.family), info.columns[place]) for place, f in zip(places, found.fields, strict=False)}
        df = found.df.select(*(given.get(k, self.default(c) if k not in given else None).alias(f"c{k}") for k, c in enumerate(info.columns)))
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        return df.coalesce(1) if size < SMALL else df, set(given)

    def append(self, name: str, info: TableInfo, df: DataFrame, ordered: bool, keyed: bool = True) -> int:
        """Number the rows, check them and list their folder.

        Rowids are the primary key, or count on from the last one. Rows of VALUES are numbered one
        after another; rows of a query by task and place in it, so numbers rise but may skip.
        """
        start, key = self.store.next_rowid(info), info.key
        # Only where given keys decide the numbers that others get are the rows needed twice.
        again = key is not None and keyed
        df = df.persist(StorageLevel.MEMORY_AND_DISK) if again else df
        try:
            if ordered:
                number = self._in_turn(df, start, key)
            else:
                first = max(start, (df.agg(F.max(f"c{key}")).first()[0] or 0) + 1) if again else start
                counted = F.lit(first).cast("bigint") + F.monotonically_increasing_id()
                number = F.coalesce(F.col(f"c{key}"), counted) if again else counted
            rows = df.withColumn(ROWID, number)
            if key is not None:
                rows = rows.withColumn(f"c{key}", F.col(ROWID))
            folder = self.store.write(rows.select(*info.schema.names))
        finally:
            if again:
                df.unpersist()
        try:
            facts = self.check(info, replace(info, folders=(folder,)))
        except SqlError:
            self.store.files.delete(f"data/{folder}")
            raise
        if facts["n"]:
            self.store.rowids[info.id] = max(start, facts["last"] + 1)
            self.store.put(name, self.compacted(replace(info, folders=(*info.folders, folder))))
        return facts["n"]

    def _in_turn(self, df: DataFrame, start: int, key: int | None) -> Column:
        place = F.col("__pos").cast("bigint")
        if key is None:
            return F.lit(start).cast("bigint") + place
        given = dict(df.select("__pos", f"c{key}").collect())  # as many as the statement lists
        numbers = []
        for k in sorted(given):
            numbers.append(given[k] if given[k] is not None else start)
            start = max(start, numbers[-1] + 1)
        return F.get(F.array(*(F.lit(v).cast("bigint") for v in numbers)), F.col("__pos"))

    def compacted(self, info: TableInfo) -> TableInfo:
        """Beyond FOLDERS folders the last ones become one, as many as it takes until the one before is
        at least twice as large. So a row is written again as often as the table doubles, not with
        every so many inserts."""
        if len(info.folders) <= FOLDERS:
            return info
        sizes = [self.store.files.size(f"data/{f}") for f in info.folders]
        first = len(sizes) - 1
        while first and sizes[first - 1] < 2 * sum(sizes[first:]):
            first -= 1
        if first == len(sizes) - 1:
            return info
        merged = self.store.write(clustered(self.store.read(info, info.folders[first:]), info))
        return replace(info, folders=(*info.folders[:first], merged))

    # constraints

    def check(self, before: TableInfo, added: TableInfo, kept: TableInfo | None = None) -> Row:
        """Nulls, primary key and unique indexes of the rows in `added`, alone and against the rest.
        Returns their number, n, and their last rowid, which one pass finds along with all that the
        rows tell of themselves."""
        new, old = self.store.read(added), self.store.read(kept or before)
        required = [f"c{k} is null" for k, c in enumerate(before.columns) if not c.nullable and not c.primary_key]
        unique = [("PrimaryKeyConflict", [f"c{before.key}"])] if before.key is not None else []
        unique += [("UniqueViolation", [f"c{before.position(c)}" for c, _ in i.columns]) for i in before.indexes.values() if i.unique]
        facts = [F.count(F.lit(1)).alias("n"), F.max(ROWID).alias("last"), F.count_if(F.expr(" or ".join(required) or "false")).alias("nulls")]
        for k, (_, keys) in enumerate(unique):
            facts += [F.count_if(F.expr(" and ".join(f"{x} is not null" for x in keys))).alias(f"filled{k}"), F.count_distinct(*keys).alias(f"different{k}")]
        found = new.agg(*facts).first()
        if found["nulls"]:
            raise SqlError("NoDefaultValue", "null in a column that is NOT NULL")
        for k, (code, keys) in enumerate(unique):
            if found[f"different{k}"] < found[f"filled{k}"] or ((kept or before).folders and _any(new.select(*keys).join(old.select(*keys), keys, "left_semi"))):
                raise SqlError(code, ", ".join(before.columns[int(x[1:])].name for x in keys))
        return found

    # update and delete

    def rows(self, info: TableInfo, name: str, where: object | None) -> tuple[DataFrame, Scope]:
        """Rows that match, each with its folder's place in the list."""
        parts = [self.store.read(info, (f,)).select("*", F.lit(k).alias("__folder")) for k, f in enumerate(info.folders)]
        df = parts[0]
        for part in parts[1:]:
            df = df.union(part)
        scope = Scope([*(Field(c.name, f"c{k}", Family[c.type], name) for k, c in enumerate(info.columns)), Field(ROWID, ROWID, Family.INT, name, True)])
        return (df if where is None else filtered(df, where, self.context(scope, filtering=True))), scope

    def rewritten(self, name: str, info: TableInfo, matched: DataFrame, new: DataFrame | None) -> int:
        """Replace the folders that hold matched rows (matched: rowid and folder, written already) by
        what is left of them, and add the new rows."""
        counts = matched.groupBy("__folder").count().collect()  # as many as the table has folders
        if not counts:
            return 0
        touched = {r["__folder"] for r in counts}
        keep = tuple(f for k, f in enumerate(info.folders) if k not in touched)
        left = self.store.read(info, tuple(info.folders[k] for k in sorted(touched))).join(matched.select(ROWID), ROWID, "left_anti").select(*info.schema.names)
        rest = self.store.write(clustered(left, info))
        folders = (*keep, rest)
        if new is not None:
            folder = self.store.write(new.select(*info.schema.names))
            facts = self.check(info, replace(info, folders=(folder,)), replace(info, folders=folders))
            folders = (*folders, folder)
            if info.key is not None:
                self.store.rowids[info.id] = max(self.store.next_rowid(info), facts["last"] + 1)
        self.store.put(name, self.compacted(replace(info, folders=folders)))
        return sum(r["count"] for r in counts)

    def update(self, statement: n.Update) -> int:
        info = self.store.table(statement.table)
        places = [info.position(c) for c, _ in statement.assignments]
        if not info.folders:
            self.typed(info, statement)
            return 0
        matched, scope = self.rows(info, statement.table, statement.where)
        context = self.context(scope)
        values = {p: coerced(x.compiled(e, context), info.columns[p]) for p, (_, e) in zip(places, statement.assignments, strict=True)}
        changed = matched.select(*(values.get(k, F.col(f"c{k}")).alias(f"c{k}") for k in range(len(info.columns))), F.col(ROWID), F.col(ROWID).alias("__old"), "__folder")
        folder = self.store.write(changed)
        written = self.store.spark.read.schema(changed.schema).parquet(self.store.folder_path(folder))
        try:
            new = written
            if info.key is not None:
                if _any(written.where(f"c{info.key} is null")):
                    raise SqlError("TypeMismatch", "a primary key can't be null")
                new = written.withColumn(ROWID, F.col(f"c{info.key}"))
            return self.rewritten(statement.table, info, written.select(F.col("__old").alias(ROWID), "__folder"), new)
        finally:
            self.store.files.delete(f"data/{folder}")

    def typed(self, info: TableInfo, statement: n.Update) -> None:
        """Raise what the assignments of an update of an empty table would raise."""
        scope = Scope([Field(c.name, f"c{k}", Family[c.type], statement.table) for k, c in enumerate(info.columns)])
        for c, e in statement.assignments:
            coerced(x.compiled(e, self.context(scope)), info.columns[info.position(c)])
        if statement.where is not None:
            x.condition(statement.where, self.context(scope))

    def delete(self, statement: n.Delete) -> int:
        info = self.store.table(statement.table)
        if not info.folders:
            if statement.where is not None:
                self.typed(info, n.Update(statement.table, (), statement.where))
            return 0
        if statement.where is None:
            count = self.store.read(info).count()
            self.store.put(statement.table, replace(info, folders=()))
            return count
        matched, _ = self.rows(info, statement.table, statement.where)
        folder = self.store.write(matched.select(ROWID, "__folder"))
        try:
            return self.rewritten(statement.table, info, self.store.spark.read.schema(f"{ROWID} long, __folder int").parquet(self.store.folder_path(folder)), None)
        finally:
            self.store.files.delete(f"data/{folder}")

    # indexes

    def create_index(self, statement: n.CreateIndex) -> None:
        info = self.store.table(statement.table)
        if statement.name in info.indexes:
            if statement.if_not_exists:
                return
            raise SqlError("IndexAlreadyExists", statement.name)
        columns = tuple((info.columns[info.position(c)].name, d) for c, d in statement.columns)
        made = replace(info, indexes=info.indexes | {statement.name: IndexInfo(columns, statement.unique)})
        if info.folders:
            if statement.unique:
                self.check(replace(info, columns=tuple(replace(c, nullable=True, primary_key=False) for c in info.columns), indexes={statement.name: made.indexes[statement.name]}), info, replace(info, folders=()))
            made = replace(made, folders=(self.store.write(clustered(self.store.read(info), made)),))
        self.store.put(statement.table, made)


def clustered(df: DataFrame, info: TableInfo) -> DataFrame:
    """Rows in ranges of the last index's columns, so that Parquet's statistics rule out most of a
    table where a query asks for a range of them."""
    if not info.indexes:
        return df
    columns = list(info.indexes.values())[-1].columns
    keys = [F.col(f"c{info.position(c)}").desc() if d else F.col(f"c{info.position(c)}").asc() for c, d in columns]
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def _any(df: DataFrame) -> bool:
    return bool(df.limit(1).count())
