"""The pipeline against brute force of each stage, on its own input."""

import hashlib
from collections import Counter, defaultdict

import corpus_pipeline
from quern.llm import quality, suffixes
from tests.llm.test_jaccard import brute_kept

FOLDER = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.select(*corpus_pipeline.COLUMNS).collect()))


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    seen = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], FOLDER).write.parquet(str(tmp_path / str(k)))
        seen.append(spark.read.parquet(str(tmp_path / str(k))))
    start, good, lined, single, cut, packed = seen

    kept = {r.doc_id for r in quality.verdicts(start).collect() if r.kept}
    assert rows(good) == [r for r in rows(start) if r[0] in kept] and 0 < len(kept) < start.count()

    keys = [{x.strip(" \t\n\x0b\x0c\r").encode().lower() for x in r[1].split("\n")} for r in rows(good)]
    count = Counter(k for x in keys for k in x if k)
    common = {k for k, n in count.items() if n >= 10}
    want = ["\n".join(x for x in r[1].split("\n") if x.strip(" \t\n\x0b\x0c\r").encode().lower() not in common) for r in rows(good)]
    assert [r[1] for r in rows(lined)] == want and [r[4] for r in rows(lined)] == list(map(len, want))

    # The stage takes five words and a similarity of 0.8, not the fingerprints of op3's query.
    leaders = set(brute_kept([(r[0], r[1]) for r in rows(lined)]))
    assert rows(single) == [r for r in rows(lined) if r[0] in leaders] and {1, 6} <= leaders and not {177, 145} & leaders

    brute = suffixes.brute_force([r[1].encode() for r in rows(single)])
    assert [len(a[1].encode()) - n for a, (_, n, _, _) in zip(rows(single), brute, strict=True)] == [len(r[1].encode()) for r in rows(cut)]
    assert [hashlib.sha256(r[1].encode()).hexdigest() for r in rows(cut)] == [x[3] for x in brute]

    pieces, tokens = defaultdict(list), {}
    for r in packed.collect():
        pieces[r.doc_id].append((r.start, r.length))
        tokens[r.doc_id] = r.doc_tokens
    assert set(pieces) == {r[0] for r in rows(cut)}
    for doc_id, parts in pieces.items():
        assert sum(n for _, n in parts) == tokens[doc_id]


def test_run_gives_the_last_stage(spark):
    assert {"doc_id", "sequence_id", "ids_crc32"} <= set(corpus_pipeline.run(spark, FOLDER).columns)


def test_stages_take_odd_documents(spark):
    """Nulls, empty texts, repeated rows, a text that repeats itself, and columns of names that the
    operators use inside; then an empty table."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "word " * 400, None, None, 2000), (3, "é" * 150 + " own words", "fr", "s", 160)]
    extra = [f"{k} as {x}" for k, x in enumerate(("_key", "_crc", "_rid", "_first", "_begin", "_kept", "_clean", "_quality", "_lang", "n_lines", "n_dropped", "ids", "key"))]
    named = dict(corpus_pipeline.STAGES)
    texts = [t or "" for _, t, *_ in odd]
    brute = suffixes.brute_force([t.encode() for t in texts])
    want = {
        "quality rules": [],
        "line dedup": [(i, t, x, s, len(t)) for (i, _, x, s, _), t in zip(odd, texts, strict=True)],
        "near-dedup": odd[2:],
        "suffix-array dedup": None,
    }
    for name, stage in named.items():
        docs = spark.createDataFrame(odd, schema).selectExpr("*", *extra)
        made = stage(spark, docs, FOLDER)
        if name == "packing":
            pieces = made.collect()
            assert Counter(r.doc_id for r in pieces if r.start == 0) == {None: 1, 1: 2, 2: 1, 3: 1} and sum(r.length for r in pieces) == sum(r.doc_tokens for r in pieces if r.start == 0)
        else:
            assert tuple(made.columns) == corpus_pipeline.COLUMNS
            got = made.collect()
            if want[name] is None:
                assert sorted(len(r.text.encode()) for r in got) == sorted(size - gone for size, gone, _, _ in brute) and sorted(r.doc_id or 0 for r in got) == [0, 1, 1, 2, 3]
                assert all(r.n_chars == len(r.text) for r in got)
            else:
                assert sorted(map(tuple, got), key=str) == sorted(want[name], key=str)
        assert stage(spark, spark.createDataFrame([], schema), FOLDER).count() == 0
