"""Queries over the driver's tables in the engine's dialect, each with the SQL of its expected rows.

Where the dialect and ANSI SQL agree the text is the same (SAME). Scripts build tables in a store of
their own from the attached ones and end in a SELECT.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.engine import Engine
from quern.plans.parser import statements

SAME = None

#: name: (dialect, expected)
SELECTS: dict[str, tuple[str, str | None]] = {
    "scan_all": ("SELECT * FROM region", SAME),
    "scan_lineitem": ("SELECT * FROM lineitem", SAME),
    "project_cols": ("SELECT c_custkey, c_name FROM customer", SAME),
    "project_alias": ("SELECT c_custkey AS id FROM customer AS c", SAME),
    "qualified_star": ("SELECT n.* FROM nation AS n", SAME),
    "const_select": ("SELECT 1 + 2 AS a, 7 / 2 AS b, -7 / 2 AS c, 7 / 2.0 AS d, 1 = 1.0 AS e", "SELECT 3::BIGINT AS a, 3::BIGINT AS b, -3::BIGINT AS c, 3.5::DOUBLE AS d, 1::BIGINT AS e"),
    "three_valued_logic": ("SELECT NULL AND FALSE AS a, NULL OR TRUE AS b, NOT NULL AS c, 'a' = 1 AS d, 'a' < 1 AS e, 1 < 'a' AS f", "SELECT 0::BIGINT AS a, 1::BIGINT AS b, NULL::BIGINT AS c, 0::BIGINT AS d, 1::BIGINT AS e, 1::BIGINT AS f"),
    "arith_int": ("SELECT l_orderkey * 2 + l_partkey - 1 AS x FROM lineitem", SAME),
    "int_division": ("SELECT l_orderkey / 7 AS q, -l_orderkey / 7 AS r FROM lineitem", "SELECT l_orderkey // 7 AS q, CAST(trunc(-l_orderkey / 7) AS BIGINT) AS r FROM lineitem"),
    "div_by_zero_null": ("SELECT l_orderkey / (l_orderkey - l_orderkey) AS q, l_quantity / 0 AS r FROM lineitem", "SELECT NULL::BIGINT AS q, NULL::DOUBLE AS r FROM lineitem"),
    "arith_real": ("SELECT l_quantity + 1 AS q, l_quantity / 4 AS r FROM lineitem", SAME),
    "unary_neg": ("SELECT -l_linenumber AS n, +l_linenumber AS p FROM lineitem", "SELECT -l_linenumber::BIGINT AS n, l_linenumber::BIGINT AS p FROM lineitem"),
    "filter_cmp": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 25.0", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber FROM lineitem WHERE l_quantity >= 25.0"),
    "filter_and_or_not": ("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice > 100000) AND NOT o_custkey < 50", SAME),
    "filter_truthy_int": ("SELECT n_name FROM nation WHERE n_regionkey", "SELECT n_name FROM nation WHERE n_regionkey <> 0"),
    "filter_between": ("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 20", SAME),
    "filter_not_between": ("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity NOT BETWEEN 10 AND 20", SAME),
    "filter_in_list": ("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O')", SAME),
    "filter_not_in_list": ("SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN ('F', 'O')", SAME),
    "in_list_null": ("SELECT n_nationkey, n_nationkey IN (1, NULL) AS a, n_nationkey NOT IN (1, 2) AS b, n_nationkey IN () AS c FROM nation", "SELECT n_nationkey::BIGINT AS n_nationkey, CAST(n_nationkey IN (1, NULL) AS BIGINT) AS a, CAST(n_nationkey NOT IN (1, 2) AS BIGINT) AS b, 0::BIGINT AS c FROM nation"),
    "is_null": ("SELECT c_custkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000.0 WHERE o_orderkey IS NULL", SAME),
    "is_not_null": ("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000.0 WHERE o_orderkey IS NOT NULL", SAME),
    "case_searched": ("SELECT o_orderkey, CASE WHEN o_totalprice > 150000 THEN 'high' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'low' END AS band FROM orders", SAME),
    "case_simple": ("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code FROM orders", "SELECT o_orderkey, CAST(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS BIGINT) AS code FROM orders"),
    "cast_real_int": ("SELECT CAST(o_totalprice AS INT) AS a, CAST(-o_totalprice AS INT) AS b FROM orders", "SELECT CAST(trunc(o_totalprice) AS BIGINT) AS a, CAST(trunc(-o_totalprice) AS BIGINT) AS b FROM orders"),
    "cast_int_text": ("SELECT CAST(o_orderkey AS TEXT) AS t, CAST(o_orderkey > 5 AS TEXT) AS u FROM orders", "SELECT CAST(o_orderkey AS VARCHAR) AS t, CASE WHEN o_orderkey > 5 THEN '1' ELSE '0' END AS u FROM orders"),
    "cast_int_real": ("SELECT CAST(o_orderkey AS REAL) AS r FROM orders", "SELECT CAST(o_orderkey AS DOUBLE) AS r FROM orders"),
    "cast_text_int": ("SELECT CAST(CAST(o_orderkey AS TEXT) AS INT) AS i FROM orders", "SELECT o_orderkey AS i FROM orders"),
    "cast_real_text": (
        "SELECT CAST(CAST(l_quantity AS INT) + 0.0 AS TEXT) AS t, CAST(l_linenumber + 0.5 AS TEXT) AS u, CAST(l_partkey * 12345678.25 AS TEXT) AS v, CAST((l_orderkey + 1) * 100000000000000000.0 AS TEXT) AS w, CAST(-(l_partkey + 1) / 1000000000.0 AS TEXT) AS x FROM lineitem",
        "SELECT CAST(CAST(trunc(l_quantity) AS BIGINT) AS VARCHAR) AS t, CAST(l_linenumber + 0.5::DOUBLE AS VARCHAR) AS u, regexp_replace(CAST(l_partkey * 12345678.25::DECIMAL(20, 2) AS VARCHAR), '\\.?0+$', '') AS v, "
        "(l_orderkey + 1) || '00000000000000000' AS w, regexp_replace('-0.' || lpad(CAST(l_partkey + 1 AS VARCHAR), 9, '0'), '0+$', '') AS x FROM lineitem",
    ),
    "cast_text_strict": (
        "SELECT o_orderkey, CAST(s AS INT) AS i, CAST(s AS REAL) AS r FROM digits_view",
        "SELECT o_orderkey, -o_orderkey AS i, CAST(-o_orderkey AS DOUBLE) AS r FROM orders",
    ),
    "fn_abs": ("SELECT c_custkey, abs(c_acctbal) AS a, abs(-c_custkey) AS b FROM customer", SAME),
    "fn_coalesce": ("SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'F'), 'none') AS s FROM orders", SAME),
    "fn_nullif": ("SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s, nullif(o_custkey, 'x') AS k FROM orders", "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s, o_custkey AS k FROM orders"),
    "agg_count_star": ("SELECT COUNT(*) AS c FROM lineitem", SAME),
    "agg_count_col": ("SELECT COUNT(nullif(o_orderstatus, 'F')) AS c, COUNT(ALL o_orderkey) AS d FROM orders", "SELECT COUNT(nullif(o_orderstatus, 'F')) AS c, COUNT(o_orderkey) AS d FROM orders"),
    "agg_sum": ("SELECT SUM(CAST(o_totalprice AS INT)) AS s, SUM(l.l_linenumber) AS t FROM orders JOIN lineitem l ON o_orderkey = l_orderkey", "SELECT CAST(SUM(CAST(trunc(o_totalprice) AS BIGINT)) AS BIGINT) AS s, CAST(SUM(l_linenumber) AS BIGINT) AS t FROM orders JOIN lineitem l ON o_orderkey = l_orderkey"),
    "agg_avg": ("SELECT AVG(l_linenumber) AS a FROM lineitem", SAME),
    "agg_min": ("SELECT MIN(o_totalprice) AS a, MIN(o_orderkey) AS b, MIN(o_orderstatus) AS c FROM orders", SAME),
    "agg_max": ("SELECT MAX(o_totalprice) AS a, MAX(o_orderkey) AS b, MAX(o_orderstatus) AS c FROM orders", SAME),
    "agg_empty_input": ("SELECT COUNT(*) AS c, SUM(o_orderkey) AS s, AVG(o_orderkey) AS a, MIN(o_orderkey) AS m FROM orders WHERE o_orderkey < 0", "SELECT COUNT(*) AS c, CAST(SUM(o_orderkey) AS BIGINT) AS s, AVG(o_orderkey) AS a, MIN(o_orderkey) AS m FROM orders WHERE o_orderkey < 0"),
    "group_by_one": ("SELECT l_returnflag, COUNT(*) AS c FROM lineitem GROUP BY l_returnflag", SAME),
    "group_by_multi": ("SELECT l_returnflag, l_linestatus, COUNT(*) AS c, SUM(CAST(l_extendedprice AS INT)) AS s FROM lineitem GROUP BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, COUNT(*) AS c, CAST(SUM(CAST(trunc(l_extendedprice) AS BIGINT)) AS BIGINT) AS s FROM lineitem GROUP BY l_returnflag, l_linestatus"),
    "group_by_no_agg": ("SELECT o_orderstatus FROM orders GROUP BY o_orderstatus", SAME),
    "group_by_star": ("SELECT * FROM lineitem GROUP BY l_linestatus, l_returnflag", "SELECT l_returnflag, l_linestatus FROM lineitem GROUP BY l_linestatus, l_returnflag"),
    "group_by_null_key": ("SELECT s, COUNT(*) AS c FROM status_view GROUP BY s", "SELECT nullif(o_orderstatus, 'F') AS s, COUNT(*) AS c FROM orders GROUP BY 1"),
    "having": ("SELECT o_custkey, COUNT(*) AS c FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12", SAME),
    "having_hidden_agg": ("SELECT o_custkey FROM orders GROUP BY o_custkey HAVING MAX(o_totalprice) > 200000.0 AND COUNT(*) > 5", SAME),
    "having_global": ("SELECT COUNT(*) AS c FROM orders HAVING COUNT(*) > 1", SAME),
    "expr_over_agg": ("SELECT l_returnflag, SUM(l_linenumber) / COUNT(*) AS q, abs(COUNT(*)) + 1 AS r, CASE WHEN COUNT(*) > 100 THEN 'many' ELSE 'few' END AS n FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, CAST(SUM(l_linenumber) // COUNT(*) AS BIGINT) AS q, COUNT(*) + 1 AS r, CASE WHEN COUNT(*) > 100 THEN 'many' ELSE 'few' END AS n FROM lineitem GROUP BY l_returnflag"),
    "count_distinct": ("SELECT COUNT(DISTINCT o_custkey) AS c FROM orders", SAME),
    "sum_distinct": ("SELECT l_returnflag, SUM(DISTINCT l_linenumber) AS s FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, CAST(SUM(DISTINCT l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY l_returnflag"),
    "mixed_distinct": ("SELECT l_linestatus, COUNT(DISTINCT l_suppkey) AS a, COUNT(DISTINCT l_partkey) AS b, AVG(DISTINCT l_linenumber) AS c, MIN(DISTINCT l_linenumber) AS d, COUNT(*) AS e FROM lineitem GROUP BY l_linestatus", "SELECT l_linestatus, COUNT(DISTINCT l_suppkey) AS a, COUNT(DISTINCT l_partkey) AS b, AVG(DISTINCT l_linenumber) AS c, MIN(DISTINCT l_linenumber::BIGINT) AS d, COUNT(*) AS e FROM lineitem GROUP BY l_linestatus"),
    "select_distinct": ("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", SAME),
    "order_by_asc": ("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal", SAME),
    "order_by_desc": ("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey ASC", SAME),
    "order_by_position": ("SELECT c_mktsegment, c_custkey FROM customer ORDER BY 1, 2 DESC", SAME),
    "order_by_alias": ("SELECT c_custkey AS k FROM customer ORDER BY k", SAME),
    "order_by_expr": ("SELECT c_custkey FROM customer ORDER BY abs(c_custkey - 50)", SAME),
    "join_inner": ("SELECT o_orderkey, c_name FROM orders INNER JOIN customer ON o_custkey = c_custkey", SAME),
    "join_bare": ("SELECT o_orderkey, c_name FROM orders JOIN customer ON orders.o_custkey = customer.c_custkey", SAME),
    "join_left": ("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey", SAME),
    "join_cross": ("SELECT r_name, n_name FROM region CROSS JOIN nation", SAME),
    "join_comma_where": ("SELECT r_name, n_name FROM region, nation WHERE r_regionkey = n_regionkey", SAME),
    "join_group": ("SELECT n_name, s_name FROM (region JOIN nation ON r_regionkey = n_regionkey) JOIN supplier ON s_nationkey = n_nationkey", SAME),
    "join_theta": ("SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey", SAME),
    "join_residual": ("SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_extendedprice < o_totalprice / 4", "SELECT o_orderkey, l_linenumber::BIGINT AS l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_extendedprice < o_totalprice / 4"),
    "join_null_keys": ("SELECT a.o_orderkey AS x, c_custkey AS y FROM orders a JOIN customer ON nullif(a.o_custkey, 7) = nullif(c_custkey, 7)", "SELECT a.o_orderkey AS x, c_custkey AS y FROM orders a JOIN customer ON a.o_custkey = c_custkey WHERE c_custkey <> 7"),
    "join_int_real_key": ("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey + 0.0 = r_regionkey", SAME),
    "join_left_where_right": ("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 100000.0", SAME),
    "join_left_both_sides": ("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > c_acctbal * 20", SAME),
    "join_self": ("SELECT a.n_name AS x, b.n_name AS y FROM nation AS a, nation AS b WHERE a.n_regionkey = b.n_regionkey", SAME),
    "join_three_way": ("SELECT c_name, o_orderkey, l_partkey FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING'", SAME),
    "pushdown_mixed": ("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000.0 AND c_acctbal < 0.0", SAME),
    "generate_series": ("SELECT generate_series AS i FROM generate_series(1000)", "SELECT range AS i FROM range(1000)"),
    "series_join": ("SELECT gs.generate_series AS i, n_name FROM nation JOIN generate_series(5) AS gs ON gs.generate_series = n_regionkey", "SELECT range AS i, n_name FROM nation JOIN range(5) ON range = n_regionkey"),
    "view_query": ("SELECT k, v FROM rich_view WHERE v > 5000", "SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_acctbal > 1000 AND c_acctbal > 5000"),
    "view_over_view": ("SELECT COUNT(*) AS c FROM richest_view", "SELECT COUNT(*) AS c FROM customer WHERE c_acctbal > 9000"),
    "scalar_subquery": ("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) FROM orders)", SAME),
    "scalar_subquery_corr": ("SELECT c_custkey, (SELECT COUNT(*) FROM orders WHERE o_custkey = c_custkey) AS n, (SELECT MAX(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS m FROM customer", SAME),
    "scalar_subquery_empty": ("SELECT r_name, (SELECT n_name FROM nation WHERE n_nationkey < 0) AS n FROM region", SAME),
    "in_subquery": ("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000.0)", SAME),
    "not_in_subquery": ("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000.0)", SAME),
    "not_in_subquery_null": ("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT nullif(o_custkey, 7) FROM orders)", "SELECT c_custkey FROM customer WHERE FALSE"),
    "in_subquery_select_list": ("SELECT n_nationkey, n_nationkey IN (SELECT nullif(r_regionkey, 3) FROM region) AS a FROM nation", "SELECT n_nationkey::BIGINT AS n_nationkey, CASE WHEN n_nationkey IN (0, 1, 2, 4) THEN 1::BIGINT END AS a FROM nation"),
    "in_subquery_corr": ("SELECT c_custkey FROM customer WHERE c_mktsegment IN (SELECT 'BUILDING' FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000.0)", SAME),
    "nested_subquery": ("SELECT r_name FROM region WHERE r_regionkey = (SELECT MIN(n_regionkey) FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 0))", SAME),
    "subquery_in_having": ("SELECT o_custkey, COUNT(*) AS c FROM orders GROUP BY o_custkey HAVING COUNT(*) > (SELECT COUNT(*) / 100 FROM customer)", "SELECT o_custkey, COUNT(*) AS c FROM orders GROUP BY o_custkey HAVING COUNT(*) > (SELECT COUNT(*) // 100 FROM customer)"),
    "flagship": (
        "SELECT n.n_name, COUNT(*) AS orders, SUM(CAST(o.o_totalprice AS INT)) AS revenue FROM orders AS o JOIN customer AS c ON o.o_custkey = c.c_custkey "
        "JOIN nation AS n ON c.c_nationkey = n.n_nationkey WHERE o.o_totalprice > 1000.0 GROUP BY n_name HAVING COUNT(*) > 1 ORDER BY revenue DESC, n_name",
        "SELECT n.n_name, COUNT(*) AS orders, CAST(SUM(CAST(trunc(o.o_totalprice) AS BIGINT)) AS BIGINT) AS revenue FROM orders AS o JOIN customer AS c ON o.o_custkey = c.c_custkey "
        "JOIN nation AS n ON c.c_nationkey = n.n_nationkey WHERE o.o_totalprice > 1000.0 GROUP BY n_name HAVING COUNT(*) > 1",
    ),
}

#: Views that some of the queries above read.
VIEWS = """
CREATE VIEW rich_view AS SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_acctbal > 1000;
CREATE VIEW richest_view AS SELECT k FROM rich_view WHERE v > 9000;
CREATE VIEW digits_view AS SELECT o_orderkey, CAST(-o_orderkey AS TEXT) AS s FROM orders;
CREATE VIEW status_view AS SELECT nullif(o_orderstatus, 'F') AS s FROM orders;
"""

ORDERS = "CREATE TABLE o (k INTEGER PRIMARY KEY, cust INT NOT NULL, price REAL, status TEXT DEFAULT 'new');"
COPY = "INSERT INTO o SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders;"
COPIED = "SELECT o_orderkey AS k, o_custkey AS cust, o_totalprice AS price, o_orderstatus AS status FROM orders"

SCRIPTS: dict[str, tuple[str, str]] = {
    "insert_values": (
        "CREATE TABLE t (a INT NOT NULL, b TEXT DEFAULT 'x', c REAL); INSERT INTO t VALUES (1, 'one', 1.5), (2, DEFAULT, 2), (1 + 2, 'it''s', NULL); INSERT INTO t (c, a) VALUES (-4.5, 4); SELECT a, b, c, __rowid AS r FROM t",
        "SELECT * FROM (VALUES (1::BIGINT, 'one', 1.5::DOUBLE, 1::BIGINT), (2, 'x', 2, 2), (3, 'it''s', NULL, 3), (4, 'x', -4.5, 4)) AS t(a, b, c, r)",
    ),
    "insert_select": (f"{ORDERS} {COPY} SELECT * FROM o", COPIED),
    "insert_select_columns": (f"{ORDERS} INSERT INTO o (cust, k) SELECT o_custkey, o_orderkey FROM orders; SELECT * FROM o", "SELECT o_orderkey AS k, o_custkey AS cust, NULL::DOUBLE AS price, 'new' AS status FROM orders"),
    "update_where": (f"{ORDERS} {COPY} UPDATE o SET price = price * 2, status = 'big' WHERE price > 100000.0; SELECT * FROM o", f"SELECT k, cust, CASE WHEN price > 100000 THEN price * 2 ELSE price END AS price, CASE WHEN price > 100000 THEN 'big' ELSE status END AS status FROM ({COPIED})"),
    "update_swap": ("CREATE TABLE t (a INT, b INT); INSERT INTO t SELECT n_nationkey, n_regionkey FROM nation; UPDATE t SET a = b, b = a; SELECT * FROM t", "SELECT n_regionkey::BIGINT AS a, n_nationkey::BIGINT AS b FROM nation"),
    "update_subquery": (f"{ORDERS} {COPY} UPDATE o SET status = 'vip' WHERE cust IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000.0); SELECT k, status FROM o", "SELECT o_orderkey AS k, CASE WHEN c_acctbal > 5000 THEN 'vip' ELSE o_orderstatus END AS status FROM orders JOIN customer ON o_custkey = c_custkey"),
    "delete_where": (f"{ORDERS} {COPY} DELETE FROM o WHERE status = 'F' OR price < 50000.0; SELECT * FROM o", f"{COPIED} WHERE NOT (o_orderstatus = 'F' OR o_totalprice < 50000)"),
    "delete_all": (f"{ORDERS} {COPY} DELETE FROM o; SELECT COUNT(*) AS c FROM o", "SELECT 0::BIGINT AS c"),
    "txn_commit": (f"{ORDERS} BEGIN; {COPY} DELETE FROM o WHERE k > 100; COMMIT; SELECT * FROM o", f"{COPIED} WHERE o_orderkey <= 100"),
    "txn_rollback": (f"{ORDERS} {COPY} BEGIN; DELETE FROM o WHERE k > 100; UPDATE o SET price = 0; ROLLBACK; SELECT * FROM o", COPIED),
    "pk_autoassign": ("CREATE TABLE t (id INTEGER PRIMARY KEY, v TEXT); INSERT INTO t (v) VALUES ('a'); INSERT INTO t VALUES (3, 'b'); INSERT INTO t (v) VALUES ('c'), ('d'); INSERT INTO t VALUES (10, 'e'), (NULL, 'f'); SELECT * FROM t", "SELECT * FROM (VALUES (1::BIGINT, 'a'), (3, 'b'), (4, 'c'), (5, 'd'), (10, 'e'), (11, 'f')) AS t(id, v)"),
    "point_lookup": (f"{ORDERS} {COPY} SELECT k, cust FROM o WHERE __rowid = 7", "SELECT o_orderkey AS k, o_custkey AS cust FROM orders WHERE o_orderkey = 7"),
    "index_range_scan": (f"{ORDERS} {COPY} CREATE INDEX by_price ON o (price); SELECT k FROM o WHERE price > 50000 AND price < 60000.0 AND cust > 10", "SELECT o_orderkey AS k FROM orders WHERE o_totalprice > 50000 AND o_totalprice < 60000 AND o_custkey > 10"),
    "index_desc_composite": (f"{ORDERS} {COPY} CREATE INDEX by_two ON o (status DESC, price); SELECT k FROM o WHERE status < 'P' AND price >= 100000", "SELECT o_orderkey AS k FROM orders WHERE o_orderstatus < 'P' AND o_totalprice >= 100000"),
    "unique_index": ("CREATE TABLE t (a INT, b TEXT); CREATE UNIQUE INDEX u ON t (a); INSERT INTO t VALUES (1, 'x'), (NULL, 'y'), (NULL, 'z'); DELETE FROM t WHERE a = 1; INSERT INTO t VALUES (1, 'again'); SELECT * FROM t", "SELECT * FROM (VALUES (1::BIGINT, 'again'), (NULL, 'y'), (NULL, 'z')) AS t(a, b)"),
    "view_over_join": (f"{ORDERS} {COPY} CREATE VIEW v AS SELECT c_name, k, price FROM o JOIN customer ON cust = c_custkey; SELECT c_name, COUNT(*) AS n FROM v WHERE price > 1000 GROUP BY c_name", "SELECT c_name, COUNT(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 1000 GROUP BY c_name"),
    "drop_and_recreate": ("CREATE TABLE t (a INT); INSERT INTO t VALUES (1); DROP TABLE t; DROP TABLE IF EXISTS t; CREATE TABLE t (b TEXT); INSERT INTO t VALUES ('new'); CREATE VIEW v AS SELECT b FROM t; DROP VIEW IF EXISTS v; SELECT * FROM t", "SELECT 'new' AS b"),
    "information_schema_tables": (f"{ORDERS} CREATE TABLE t (a INT); SELECT table_schema, table_name, column_count FROM information_schema.tables", "SELECT * FROM (VALUES ('main', 'o', 4::BIGINT), ('main', 't', 1)) AS t(table_schema, table_name, column_count)"),
    "information_schema_columns": (f"{ORDERS} SELECT COLUMN_NAME, ORDINAL_POSITION, COLUMN_DEFAULT, IS_NULLABLE, DATA_TYPE FROM information_schema.columns WHERE TABLE_NAME = 'o'", "SELECT * FROM (VALUES ('k', 0::BIGINT, NULL, 'YES', 'INT'), ('cust', 1, NULL, 'NO', 'INT'), ('price', 2, NULL, 'YES', 'REAL'), ('status', 3, '''new''', 'YES', 'TEXT')) AS t(COLUMN_NAME, ORDINAL_POSITION, COLUMN_DEFAULT, IS_NULLABLE, DATA_TYPE)"),
    "pages": (f"{ORDERS} {COPY} SELECT page_type, MIN(page_id) >= 0 AS ok FROM __pages GROUP BY page_type", "SELECT * FROM (VALUES ('header', 1::BIGINT), ('btree_leaf', 1)) AS t(page_type, ok)"),
    "order_by_rowids": (
        "CREATE TABLE t (id INTEGER PRIMARY KEY, k INT, v REAL); INSERT INTO t (k, v) SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0.0 ORDER BY c_acctbal DESC, c_custkey; SELECT id, k, v FROM t",
        "SELECT row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS id, c_custkey AS k, c_acctbal AS v FROM customer WHERE c_acctbal > 0",
    ),
    "hidden_columns": (f"{ORDERS} {COPY} SELECT COUNT(*) AS c FROM o WHERE __rowid = k AND __slotid >= 0 AND __pageid > 0", "SELECT COUNT(*) AS c FROM orders"),
}


def _select(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        engine = Engine(spark).attach(folder)
        if "_view" in text:
            engine.script(VIEWS)
        return engine.sql(text)

    return run


def _script(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        engine = Engine(spark).attach(folder)
        *before, last = statements(text)
        for statement in before:
            engine.sql(statement)
        return engine.sql(last)

    return run


def page_slots(spark: SparkSession, folder: str) -> DataFrame:
    """The slots of a table's only data file, whose page number is looked up first."""
    engine = Engine(spark).attach(folder)
    engine.script("CREATE TABLE t (k INT, name TEXT); INSERT INTO t SELECT n_nationkey, n_name FROM nation")
    ((page,),) = engine.execute("SELECT page_id FROM __pages WHERE page_type = 'btree_leaf'").rows()
    return engine.sql(f"SELECT slot_idx, rowid - slot_idx AS above, data_len > 0 AS filled, is_overflow FROM __page_slots({page})")


QUERIES = {k: _select(text) for k, (text, _) in SELECTS.items()} | {k: _script(text) for k, (text, _) in SCRIPTS.items()} | {"page_slots": page_slots}
ORACLE_SQL = {k: expected or text for k, (text, expected) in SELECTS.items()} | {k: expected for k, (_, expected) in SCRIPTS.items()} | {
    "page_slots": "SELECT range AS slot_idx, 1::BIGINT AS above, 1::BIGINT AS filled, 0::BIGINT AS is_overflow FROM range(25)"
}
