"""The engine: parity with DuckDB, logic test files, crashes, transactions, random expressions."""

from concurrent.futures import ThreadPoolExecutor
from decimal import Decimal
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quern import cli, queries, slt
from quern.engine import Engine
from quern.errors import CODES, SqlError
from quern.plans import nodes as n
from quern.plans import types
from quern.plans.lexer import tokenize
from quern.plans.parser import parse, parse_expression, statements
from quern.sources.files import Files

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def expected():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return lambda sql: connection.execute(sql).fetchdf()


def comparable(frame):
    columns = sorted(frame.columns)

    def plain(value):
        if value is None or (isinstance(value, float) and value != value) or str(value) in ("<NA>", "NaT", "nan"):
            return None
        return float(value) if isinstance(value, (int, float, np.integer, np.floating)) else str(value)

    return columns, sorted((tuple(map(plain, row)) for row in frame[columns].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_parity(spark, expected, name):
    assert comparable(queries.QUERIES[name](spark, FOLDER).toPandas()) == comparable(expected(queries.ORACLE_SQL[name]))


@pytest.mark.parametrize("path", sorted((Path(__file__).parent / "slt").glob("*.slt")), ids=lambda p: p.stem)
def test_logic_files(spark, tmp_path, path):
    assert slt.run(Engine(spark, str(tmp_path / "db")), path.read_text()) == []


def test_plans_push_filters_and_prune_columns(spark):
    engine = Engine(spark).attach(FOLDER)

    def plan(sql):
        return engine.sql(sql)._jdf.queryExecution().executedPlan().toString()

    scan = plan("SELECT l_orderkey FROM lineitem WHERE l_quantity >= 25.0")
    assert "GreaterThanOrEqual(l_quantity,25.0)" in scan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in scan
    joined = plan("SELECT o_orderkey FROM orders, customer WHERE o_custkey = c_custkey AND c_acctbal < 0.0")
    assert "HashJoin" in joined or "SortMergeJoin" in joined
    assert "NestedLoop" not in joined and "Cartesian" not in joined
    assert "LeftSemi" in plan("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")


def test_reopening_and_rowids(spark, tmp_path):
    path = str(tmp_path / "db")
    with Engine(spark, path) as engine:
        engine.script("CREATE TABLE t (a INT, b BLOB); INSERT INTO t VALUES (1, 'x'), (2, NULL); CREATE VIEW v AS SELECT a FROM t; BEGIN; INSERT INTO t (a) VALUES (3);")
    again = Engine(spark, path)
    assert again.sql("SELECT a, __rowid FROM t ORDER BY a").collect() == [(1, 1), (2, 2)]
    assert again.execute("INSERT INTO t (a) SELECT a + 10 FROM t").count == 2
    assert [r[0] for r in again.sql("SELECT a FROM v ORDER BY 1").collect()] == [1, 2, 11, 12]
    assert len({r[0] for r in again.sql("SELECT __rowid FROM t").collect()}) == 4
    assert again.sql("SELECT b FROM t WHERE a = 1").first()[0] == b"x"


def test_crash_before_the_manifest_leaves_the_old_state(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "db")
    engine = Engine(spark, path)
    engine.script("CREATE TABLE t (a INT); INSERT INTO t VALUES (1), (2);")

    def crash(*_):
        raise OSError("crashed")

    for statement in ("INSERT INTO t VALUES (9)", "UPDATE t SET a = 0", "DELETE FROM t WHERE a = 1"):
        with monkeypatch.context() as patch:
            patch.setattr(engine.store.files, "publish", crash)
            with pytest.raises(OSError):
                engine.execute(statement)
        engine = Engine(spark, path)
        assert sorted(r[0] for r in engine.sql("SELECT a FROM t").collect()) == [1, 2]
    engine.store.sweep(age=-60)
    assert len(engine.store.files.names("data")) == 1


def test_a_second_writer_is_refused(spark, tmp_path):
    path = str(tmp_path / "db")
    one = Engine(spark, path)
    one.script("CREATE TABLE t (a INT)")
    two = Engine(spark, path)
    assert one.execute("INSERT INTO t VALUES (1)").count == 1
    with pytest.raises(RuntimeError):
        two.execute("INSERT INTO t VALUES (2)")


def test_opening_a_store_leaves_an_open_transaction_alone(spark, tmp_path):
    path = str(tmp_path / "db")
    first = Engine(spark, path)
    first.script("CREATE TABLE t (a INT); INSERT INTO t VALUES (1); BEGIN; INSERT INTO t VALUES (2)")
    second = Engine(spark, path)
    assert second.execute("SELECT * FROM t").rows() == [(1,)]
    assert second.store.sweep() == []
    assert first.execute("COMMIT").kind == "affected"
    assert sorted(first.execute("SELECT * FROM t").rows()) == sorted(Engine(spark, path).execute("SELECT * FROM t").rows()) == [(1,), (2,)]


def test_sweep_deletes_only_what_is_old_and_listed_nowhere(spark, tmp_path):
    path = str(tmp_path / "db")
    engine = Engine(spark, path)
    engine.script("CREATE TABLE t (a INT); INSERT INTO t VALUES (1); BEGIN; INSERT INTO t VALUES (2)")
    loose = engine.store.write(spark.range(3))
    assert engine.store.sweep() == [] and engine.store.sweep(age=-60) == [f"data/{loose}"]
    engine.execute("COMMIT")
    assert sorted(engine.execute("SELECT * FROM t").rows()) == [(1,), (2,)]


def test_of_racing_commits_one_wins(spark, tmp_path):
    files = Files(spark, str(tmp_path / "files"))
    files.make_folder()
    with ThreadPoolExecutor(8) as pool:
        for k in range(10):
            won = list(pool.map(lambda x, k=k: (x, files.publish(f"m-{k}", f"text of {x}")), range(8)))
            winners = [x for x, done in won if done]
            assert len(winners) == 1 and files.read(f"m-{k}") == f"text of {winners[0]}"
    assert not [x for x in files.names() if x.endswith(".draft")]


def test_many_inserts_are_compacted(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "db"))
    engine.script("CREATE TABLE t (a INT); CREATE INDEX i ON t (a);" + "INSERT INTO t VALUES (1);" * 18)
    assert len(engine.store.table("t").folders) < 6 and engine.sql("SELECT COUNT(*) FROM t").first()[0] == 18


def test_only_small_folders_are_merged(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "db"))
    engine.attach(FOLDER).script("CREATE TABLE t (a INT); INSERT INTO t SELECT l_orderkey * l_partkey FROM lineitem;")
    large = engine.store.table("t").folders[0]
    engine.script("INSERT INTO t VALUES (1);" * 17)
    folders = engine.store.table("t").folders
    assert folders[0] == large and len(folders) < 6 and engine.sql("SELECT COUNT(*) FROM t").first()[0] == 6017


def test_select_runs_when_its_rows_are_asked_for(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "db"))
    engine.script("CREATE TABLE t (a INT); INSERT INTO t VALUES (1)")
    first, wrong = engine.execute("SELECT a FROM t"), engine.execute("SELECT a + 9223372036854775807 FROM t")
    engine.execute("UPDATE t SET a = 2")
    assert first._rows is None and first.df.count() == 1 and first.rows() == [(1,)]
    assert (wrong.kind, wrong.code, wrong.rows()) == ("error", "InvalidNumber", [])


def test_not_in_of_a_large_set_is_not_broadcast(spark):
    engine = Engine(spark).attach(FOLDER)
    texts = [
        "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000.0)",
        "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT nullif(o_custkey, 7) FROM orders)",
        "SELECT c_custkey FROM customer WHERE nullif(c_custkey, 5) NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000.0)",
        "SELECT c_custkey FROM customer WHERE nullif(c_custkey, 5) NOT IN (SELECT o_custkey FROM orders WHERE o_custkey < 0)",
        "SELECT c_custkey FROM customer WHERE c_mktsegment NOT IN (SELECT 'BUILDING' FROM orders WHERE o_custkey = c_custkey)",
    ]
    want = [sorted(engine.sql(x).collect()) for x in texts]
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert [sorted(engine.sql(x).collect()) for x in texts] == want
        plan = engine.sql(texts[0])._jdf.queryExecution().executedPlan().toString()
        assert "LeftAnti" in plan and "Broadcast" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert len(want[1]) == 0 and len(want[3]) == 150


def test_random_changes_match_a_model(spark, tmp_path):
    random = np.random.default_rng(11)
    engine, model, saved = Engine(spark, str(tmp_path / "db")), {}, None
    engine.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, a INT, b INT)")
    for _ in range(40):
        k, a = int(random.integers(12)), int(random.integers(100))
        match random.integers(6):
            case 0 | 1:
                result = engine.execute(f"INSERT INTO t VALUES ({k}, {a}, {a} / 7)")
                assert (result.code == "PrimaryKeyConflict") == (k in model)
                model.setdefault(k, (a, a // 7))
            case 2:
                assert engine.execute(f"UPDATE t SET a = b, b = a + {a} WHERE id >= {k}").count == sum(x >= k for x in model)
                model = {x: (v[1], v[0] + a) if x >= k else v for x, v in model.items()}
            case 3:
                assert engine.execute(f"DELETE FROM t WHERE id = {k} OR a > 150").count == sum(x == k or v[0] > 150 for x, v in model.items())
                model = {x: v for x, v in model.items() if not (x == k or v[0] > 150)}
            case 4 if saved is None:
                engine.execute("BEGIN")
                saved = dict(model)
            case 5 if saved is not None:
                if a % 2:
                    engine.execute("COMMIT")
                else:
                    engine.execute("ROLLBACK")
                    model = saved
                saved = None
    assert {r[0]: (r[1], r[2]) for r in engine.sql("SELECT * FROM t").collect()} == model


def random_expression(random, depth, kind):
    """(dialect, DuckDB) texts of one random expression of a kind over the columns of the test below."""
    if depth == 0 or random.random() < 0.2:
        if kind == "int":
            return [("i", "i"), ("j", "j"), ("NULL", "NULL::BIGINT"), ("3", "3::BIGINT"), ("0", "0::BIGINT")][random.integers(5)]
        if kind == "real":
            return [("r", "r"), ("0.5", "0.5::DOUBLE")][random.integers(2)]
        return [("i < j", "i < j"), ("r IS NULL", "r IS NULL"), ("TRUE", "TRUE"), ("s = 'b'", "s = 'b'")][random.integers(4)]
    sub = lambda k: random_expression(random, depth - 1, k)
    if kind == "int":
        a, b = sub("int"), sub("int")
        c = sub("bool")
        return [
            (f"({a[0]} + {b[0]})", f"({a[1]} + {b[1]})"),
            (f"({a[0]} / {b[0]})", f"CAST(CASE WHEN {b[1]} <> 0 THEN sign({a[1]}) * sign({b[1]}) * (abs({a[1]}) // abs({b[1]})) END AS BIGINT)"),
            (f"CASE WHEN {c[0]} THEN {a[0]} ELSE {b[0]} END", f"CASE WHEN {c[1]} THEN {a[1]} ELSE {b[1]} END"),
            (f"coalesce({a[0]}, {b[0]})", f"coalesce({a[1]}, {b[1]})"),
            (f"nullif({a[0]}, {b[0]})", f"nullif({a[1]}, {b[1]})"),
            (f"abs(- {a[0]})", f"abs(- ({a[1]}))"),
        ][random.integers(6)]
    if kind == "real":
        a, b = sub("real"), sub("int")
        return [(f"({a[0]} * {b[0]})", f"({a[1]} * {b[1]})"), (f"({a[0]} / {b[0]})", f"({a[1]} / nullif({b[1]}, 0))"), (f"CAST({b[0]} AS REAL)", f"CAST({b[1]} AS DOUBLE)")][random.integers(3)]
    a, b = sub("int"), sub("int")
    c, d = sub("bool"), sub("bool")
    e = sub("real")
    return [
        (f"({c[0]} AND {d[0]})", f"({c[1]} AND {d[1]})"),
        (f"({c[0]} OR NOT ({d[0]}))", f"({c[1]} OR NOT ({d[1]}))"),
        (f"({a[0]} BETWEEN {b[0]} AND {e[0]})", f"({a[1]} BETWEEN {b[1]} AND {e[1]})"),
        (f"({a[0]} NOT IN ({b[0]}, 2))", f"({a[1]} NOT IN ({b[1]}, 2))"),
        (f"(({a[0]}) >= ({e[0]}))", f"(({a[1]}) >= ({e[1]}))"),
    ][random.integers(5)]


def test_random_expressions_match_duckdb(spark):
    random = np.random.default_rng(5)
    rows = [(i, j, r, s) for i in (-7, 0, 2, None) for j in (-2, 3, None) for r in (-1.5, 2.0, None) for s in ("a", "b", None)]
    engine = Engine(spark).attach_table("t", spark.createDataFrame(rows, "i long, j long, r double, s string"))
    connection = duckdb.connect()
    connection.execute("CREATE TABLE t (i BIGINT, j BIGINT, r DOUBLE, s VARCHAR)")
    connection.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", rows)
    made = [random_expression(random, 3, ("int", "real", "bool")[k % 3]) for k in range(60)]
    ours = engine.sql("SELECT " + ", ".join(f"{a} AS c{k}" for k, (a, _) in enumerate(made)) + " FROM t").toPandas()
    theirs = connection.execute("SELECT " + ", ".join(f"CAST({b} AS {'DOUBLE' if k % 3 == 1 else 'BIGINT'}) AS c{k}" for k, (_, b) in enumerate(made)) + " FROM t").fetchdf()
    assert comparable(ours) == comparable(theirs)


def test_lexer_and_parser():
    assert [t.value for t in tokenize("a<>'x''y' -- note\n1.5;")][:-1] == ["a", "<>", "x'y", 1.5, ";"]
    assert parse_expression("1 + 2 * -x = 3 OR NOT a AND b") == n.Binary("or", n.Binary("=", n.Binary("+", n.Literal(1), n.Binary("*", n.Literal(2), n.Unary("-", n.Name("x")))), n.Literal(3)), n.Binary("and", n.Unary("not", n.Name("a")), n.Name("b")))
    assert parse("SELECT t.* FROM (a JOIN b ON x = y), c d").joins[1] == n.Join("cross", n.TableRef("c", None, None, "d"))
    assert statements("SELECT ';'; -- no;\n SELECT 2") == ["SELECT ';'", "-- no;\n SELECT 2"]
    for text in ("SELECT", "SELECT 1 2", "SELECT * FROM (a JOIN b ON 1", "INSERT INTO t VALUES", "CREATE TABLE t ()", "DROP INDEX i", "SELECT 1; SELECT 2", "UPDATE t SET a", "SELECT a FROM b EXCEPT SELECT 1", "SELECT a.b.c FROM d"):
        with pytest.raises(SqlError) as error:
            parse(text)
        assert error.value.code == "UnexpectedToken", text


def test_views_nest_up_to_a_limit(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "db"))
    engine.execute("CREATE VIEW v0 AS SELECT 1 AS a")
    made = [engine.execute(f"CREATE VIEW v{k} AS SELECT a FROM v{k - 1}").kind for k in range(1, 20)]
    assert made[:10] == ["created"] * 10 and "error" in made and engine.sql("SELECT a FROM v10").first()[0] == 1


def test_results_and_prompt(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "db"))
    assert cli.answer(engine, "CREATE TABLE t (a INT, b TEXT)") == "ok"
    assert cli.answer(engine, "INSERT INTO t VALUES (1, NULL)") == "1 rows affected"
    assert cli.answer(engine, "SELECT * FROM t").split("\n")[1:4:2] == ["| a | b    |", "| 1 | NULL |"]
    assert cli.answer(engine, "SELECT x").startswith("error ColumnNotFound")
    assert engine.execute("SELECT * FROM t").to_dict() == {"type": "rows", "columns": ["a", "b"], "rows": [[1, None]]}
    assert engine.execute("DELETE FROM t").to_dict() == {"type": "affected", "count": 1}
    assert engine.execute("nonsense").to_dict()["code"] == "UnexpectedToken"
    assert engine.execute("SELECT CAST(b AS INT) FROM t").kind == "rows"
    engine.execute("INSERT INTO t VALUES (9223372036854775807, 'word')")
    assert engine.execute("SELECT CAST(b AS INT) FROM t").code == "TypeMismatch"
    assert engine.execute("SELECT a + 1 FROM t").code == "InvalidNumber"
    assert len(CODES) == 28


def test_opaque_columns_can_only_be_selected(spark):
    engine = Engine(spark).attach(FOLDER)
    assert engine.sql("SELECT o_orderdate FROM orders").count() == 1500
    for text in ("SELECT o_orderdate + 1 FROM orders", "SELECT COUNT(*) FROM orders GROUP BY o_orderdate", "SELECT 1 FROM orders WHERE o_orderdate", "SELECT o_orderkey FROM orders WHERE o_orderdate = 'x'"):
        assert engine.execute(text).code == "TypeMismatch"


@pytest.mark.parametrize("missing", ["quern.llm", "corpus_pipeline", "tiktoken"])
def test_entry_needs_no_language_model_folder(missing):
    import subprocess
    import sys

    code = f"import sys; sys.modules[{missing!r}] = None; sys.path.insert(0, '.'); import __spark_entry__ as e; assert e.oracle_sql().keys() == e.queries().keys(); print(len(e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parent.parent, capture_output=True, text=True)
    assert done.stdout.strip() == str(len(queries.QUERIES)), done.stderr


def test_reals_as_text_in_the_fewest_digits(spark):
    """Whatever the Java version: large, small and random reals, and what has no digits."""
    chance = np.random.default_rng(4)
    values = chance.integers(0, 1 << 64, 3000, dtype=np.uint64).view(np.float64).tolist() + [(k + 1) * 1e17 for k in range(11_800, 12_800)]
    values += [k * 5e-324 for k in range(1, 300)] + [2e23, -1e23, 8.41e21, 2.2250738585072014e-308, 1.7976931348623157e308, -2e-3, 1e7, 0.1 + 0.2, -0.5, 0.00099]
    values = [x for x in values if np.isfinite(x)]

    def plain(value):
        text = format(Decimal(repr(value)), "f")
        return text.rstrip("0").rstrip(".") if "." in text else text

    column = types.plain_real(F.col("v"))
    found = spark.createDataFrame([(x,) for x in values], "v double").select("v", column.alias("t")).collect()
    assert [r.t for r in found] == [plain(r.v) for r in found]
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("-inf"),), (0.0,)], "v double").select(column.alias("t"))
    assert [r.t for r in odd.collect()] == [None, "nan", "-inf", "0"]
