"""Reads and runs sqllogictest files against an engine."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

from quern.engine import Engine

ENGINE_TAGS = ("quern",)


@dataclass
class Record:
    line: int
    kind: str
    sql: str
    types: str = ""
    sort: str = "nosort"
    code: str | None = None
    expected: list[str] = field(default_factory=list)


def records(text: str) -> Iterator[Record]:
    """`statement ok`, `statement error [code]` and `query types [sort]`; skipif and onlyif are heeded."""
    lines, at = text.split("\n"), 0
    skip = False
    while at < len(lines):
        words = lines[at].split()
        start = at + 1
        at += 1
        if not words or words[0].startswith("#"):
            continue
        if words[0] == "halt":
            return
        if words[0] in ("skipif", "onlyif"):
            skip |= (words[1] in ENGINE_TAGS) == (words[0] == "skipif")
            continue
        if words[0] not in ("statement", "query"):
            raise ValueError(f"line {start}: {lines[at - 1]!r}")
        body, expected = [], []
        while at < len(lines) and lines[at].strip() and lines[at].strip() != "----":
            body.append(lines[at])
            at += 1
        if at < len(lines) and lines[at].strip() == "----":
            at += 1
            while at < len(lines) and lines[at].strip():
                expected.append(lines[at].strip())
                at += 1
        if not skip:
            if words[0] == "statement":
                yield Record(start, words[1], "\n".join(body), code=words[2] if len(words) > 2 else None)
            else:
                yield Record(start, "query", "\n".join(body), words[1], words[2] if len(words) > 2 else "nosort", expected=expected)
        skip = False


def shown(value: object, kind: str) -> str:
    """A value as such files write it."""
    if value is None:
        return "NULL"
    if isinstance(value, (bytes, bytearray)):
        return f"<blob {len(value)}B>"
    if isinstance(value, float):
        if kind == "I":
            return str(int(value))
        value += 0.0
        return str(int(value)) if value == int(value) else repr(value)
    return str(value) if value != "" else "(empty)"


def run_record(engine: Engine, record: Record) -> str | None:
    """What is wrong, or None."""
    result = engine.execute(record.sql)
    if record.kind == "error":
        if result.kind != "error":
            return "no error"
        return None if record.code in (None, result.code) else f"error {result.code} instead of {record.code}"
    if result.kind == "error":
        return f"{result.code}: {result.message}"
    if record.kind == "ok":
        return None
    rows = [[shown(v, record.types[k] if k < len(record.types) else "T") for k, v in enumerate(row)] for row in result.rows()]
    if any(len(row) != len(record.types) for row in rows):
        return f"{len(rows[0])} columns instead of {len(record.types)}"
    if record.sort == "rowsort":
        rows.sort()
    values = [v for row in rows for v in row]
    if record.sort == "valuesort":
        values.sort()
    if len(record.expected) == 1 and " values hashing to " in record.expected[0]:
        count, digest = record.expected[0].split(" values hashing to ")
        same = int(count) == len(values) and digest == hashlib.md5("".join(f"{v}\n" for v in values).encode()).hexdigest()
        return None if same else f"{len(values)} values with another hash"
    expected = record.expected
    if record.types and expected and len(expected) * len(record.types) == len(values) and len(record.types) > 1:
        expected = [v for line in expected for v in line.split()]
    return None if values == expected else f"{values} instead of {expected}"


def run(engine: Engine, text: str) -> list[str]:
    """Failures of a file, each with its line."""
    found = []
    for record in records(text):
        wrong = run_record(engine, record)
        if wrong:
            found.append(f"line {record.line}: {wrong}")
    return found
