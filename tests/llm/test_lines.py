"""The line index: unseen documents, layers, growth of its shards, columns of any name, memory."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import common, lines


def rows(spark, data):
    return spark.createDataFrame(data, "doc_id long, text string")


def counts(data):
    return Counter(k for _, t in data for k in {lines.line_key(x) for x in (t or "").split("\n")} if k)


def kept(data, common_keys):
    return sorted((i, "\n".join(x for x in (t or "").split("\n") if lines.line_key(x) not in common_keys)) for i, t in data)


def found(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_documents_that_are_not_in_the_index(spark, tmp_path, monkeypatch):
    """A filter that wrongly holds almost every key: unseen documents are still judged exactly."""
    monkeypatch.setattr(lines.Cuckoo, "places", staticmethod(lambda words, buckets: (np.ones(len(words), np.uint16), np.zeros(len(words), np.int64), np.zeros(len(words), np.int64))))
    data = [(k, f"in all\nonly {k}") for k in range(12)]
    index = lines.LineIndex(spark, str(tmp_path / "a"), shards=1)
    probe = lines.Probe([(0, np.ones((4, 4), np.uint16).tobytes(), b"")], 1)
    assert probe.common([lines.digest(b"never seen")]).all()
    monkeypatch.undo()
    index.commit("a", inserts=rows(spark, data))
    unseen = [(100, "in all\nnever seen\nonly 3"), (101, None), (102, ""), (102, "IN ALL ")]
    assert found(index.drop_common(rows(spark, unseen))) == kept(unseen, {b"in all"})
    assert found(index.drop_common(rows(spark, data), committed=True)) == kept(data, {b"in all"}) == found(index.drop_common(rows(spark, data)))


def test_layers_and_shards_follow_the_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lines, "SHARD_KEYS", 40)
    index = lines.LineIndex(spark, str(tmp_path / "a"), min_docs=3, shards=1)
    batches = [[(100 * b + k, f"shared {k % (b + 2)}\nown {b} {k}") for k in range(20 if b else 60)] for b in range(5)]
    live = []
    for b, batch in enumerate(batches):
        assert index.commit(f"b{b}", inserts=rows(spark, batch))
        live += batch
        assert Counter({r.key: r.n for r in index.refs().collect()}).total() == counts(live).total()
    assert index.shards > 1 and len(index.layers) < 4
    again = lines.LineIndex(spark, str(tmp_path / "a"), min_docs=3)
    assert (again.shards, again.layers, again.version) == (index.shards, index.layers, 5)
    assert again.commit("less", deletes=rows(spark, batches[1]))
    live = [x for b in (0, 2, 3, 4) for x in batches[b]]
    common_keys = {k for k, n in counts(live).items() if n >= 3}
    assert found(again.drop_common(rows(spark, live), committed=True)) == kept(live, common_keys)
    assert again.commit("back", inserts=rows(spark, batches[1]))
    live += batches[1]
    assert found(again.drop_common(rows(spark, live), committed=True)) == kept(live, {k for k, n in counts(live).items() if n >= 3})
    with pytest.raises(RuntimeError):
        index.commit("late", inserts=rows(spark, batches[0]))


def test_columns_of_any_name_are_kept(spark, tmp_path):
    df = rows(spark, [(k, f"in all\nonly {k}") for k in range(12)]).selectExpr("1 as _clean", "2 as _common", "3 as _print", "4 as key", "*", "5 as _hash", "6 as n_lines")
    index = lines.LineIndex(spark, str(tmp_path / "a"))
    index.commit("a", inserts=df)
    for committed in (True, False):
        made = index.drop_common(df, committed=committed)
        assert made.columns == [*df.columns, "n_dropped"]
        assert {(r._clean, r._common, r._print, r.key, r._hash, r.n_lines, r.n_dropped) for r in made.collect()} == {(1, 2, 3, 4, 5, 2, 1)}


def test_slices_are_bounded_by_bytes():
    column = pa.array(["a" * n if n is not None else None for n in (10, 0, None, 95, 300, 20, 30, 60)])
    assert list(common.slices(column, 100)) == [(0, 3), (3, 1), (4, 1), (5, 2), (7, 1)]
    assert list(common.slices(column.slice(5), 100)) == [(0, 2), (2, 1)] and list(common.slices(column.slice(8), 100)) == []
