"""A prompt: statements end with a semicolon; .help, .tables, .quit."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from quern.engine import Engine, Result

HELP = """Statements end with ; and may span lines.
.help          this text
.tables        tables and views
.quit, .exit   leave; an open transaction is rolled back"""


def table(result: Result) -> str:
    """Rows as a table of characters."""
    names = result.df.columns
    rows = [["NULL" if v is None else str(v) for v in r] for r in result.rows()]
    widths = [max(len(x) for x in column) for column in zip(names, *rows, strict=True)]
    rule = "+".join(["", *("-" * (w + 2) for w in widths), ""])
    line = lambda cells: "|".join(["", *(f" {c.ljust(w)} " for c, w in zip(cells, widths, strict=True)), ""])
    return "\n".join([rule, line(names), rule, *map(line, rows), rule])


def answer(engine: Engine, statement: str) -> str:
    result = engine.execute(statement)
    if result.kind == "rows":
        return table(result) if result.df.columns else ""
    if result.kind == "affected":
        return f"{result.count} rows affected"
    return f"error {result.code}: {result.message}" if result.kind == "error" else "ok"


def main() -> None:
    spark = SparkSession.builder.appName("quern").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    held = ""
    with Engine(spark, sys.argv[1] if len(sys.argv) > 1 else None) as engine:
        while True:
            try:
                line = input("   ...> " if held else "quern> ")
            except EOFError:
                return
            if not held and line.strip().startswith("."):
                command = line.strip()
                if command in (".quit", ".exit"):
                    return
                print("\n".join([*engine.store.current.tables, *engine.store.current.views]) if command == ".tables" else HELP)
                continue
            held += line + "\n"
            if line.rstrip().endswith(";"):
                print(answer(engine, held))
                held = ""


if __name__ == "__main__":
    main()
