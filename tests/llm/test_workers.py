"""What Python workers hold beside an executor once their tasks are over."""

import re
from pathlib import Path

import psutil
import public_tokenizers

from quern.llm import lines, packing


def held(spark):
    """MB that each Python worker of the session has to itself, the largest first."""
    jvm = psutil.Process(spark.sparkContext._gateway.proc.pid)
    found = [x for x in jvm.children(recursive=True) if "pyspark.daemon" in x.cmdline()]
    return sorted((sum(map(int, re.findall(r"\nPrivate_Dirty:\s+(\d+)", Path(f"/proc/{x.pid}/smaps_rollup").read_text()))) / 1024 for x in found), reverse=True)


def test_workers_give_memory_back(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")

    def pack(count):
        word = "translate(substr(sha2(concat(id, ' ', k), 256), 1, 9), '0123456789', 'ghijklmnop')"
        docs = spark.range(0, count, 1, 1).selectExpr("id as doc_id", f"array_join(transform(sequence(1, 200), k -> {word}), ' ') as text")
        assert packing.pack(docs, path, pattern=public_tokenizers.PATTERN).select("doc_id").distinct().count() == count
        return held(spark)[0]

    few = pack(2)
    many = pack(4000)
    assert many < few + 60


def test_empty_tables_need_no_python(spark, tmp_path):
    index = lines.LineIndex(spark, str(tmp_path / "index"))
    for table in (index.filters(), index.refs()):
        assert "RDD" not in table._jdf.queryExecution().toString()
        assert not table.count()
    docs = spark.range(12).selectExpr("id as doc_id", "concat('same\n', id) as text")
    index.commit("all", inserts=docs)
    assert [x["n_dropped"] for x in lines.digests(index, docs).collect()] == [1] * 12
