"""Operator 8 against its definition."""

import numpy as np

from quern.llm import suffixes


def test_suffix_ranks_sort():
    random = np.random.default_rng(0)
    base = random.integers(97, 99, 400).astype(np.uint8).tobytes()
    data = np.frombuffer(base + base[50:300] + b"x" * 300 + base[:120], np.uint8)
    for length in (5, 8, 20, 100):
        starts = np.arange(len(data) - length + 1)
        strings = [data[k : k + length].tobytes() for k in starts]
        place = {x: k for k, x in reversed(list(enumerate(sorted(strings))))}
        assert suffixes.suffix_ranks(data, starts, length).tolist() == [place[x] for x in strings]


def test_anchors_cover_every_window_and_agree():
    random = np.random.default_rng(1)
    shared = random.integers(0, 256, 150).astype(np.uint8).tobytes()
    texts = [b"", b"short", shared, random.integers(97, 100, 4000).astype(np.uint8).tobytes() + shared + b"y" * 40, b"z" * 2500, random.integers(97, 123, 2_300_000).astype(np.uint8).tobytes()]
    number, start, count, offset, hashes = suffixes.anchors(texts, 100)
    for k, text in enumerate(texts):
        mine = number == k
        covered = np.concatenate([np.arange(s, s + n) for s, n in zip(start[mine], count[mine], strict=True)] or [np.zeros(0)])
        assert len(covered) == len(set(covered.tolist())) == max(0, len(text) - 99)
    of = {}
    for k, s, n, o, h in zip(number.tolist(), start.tolist(), count.tolist(), offset.tolist(), hashes.tolist(), strict=True):
        if k < 5:
            for w in range(s, s + n):
                assert of.setdefault(texts[k][w : w + 100], (s + o - w, h)) == (s + o - w, h)


def run(spark, data, clash=True, **options):
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    if clash:
        df = df.selectExpr("*", "1 as start", "'x' as part", "2 as begin", "3 as rid", "4 as n_bytes")
    return sorted(map(tuple, suffixes.digests(df, **options).collect()), key=lambda x: (x[0] is not None, x[0]))


def test_against_definition(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    data = [(r.doc_id, r.text) for r in rows]
    passage = "é passage that several documents share, of more than one hundred bytes, with words and ünïcode in it. " * 2
    long = " ".join(f"w{i % 997}x{i % 13}" for i in range(9000))
    data += [(2000, passage + "own text"), (2001, "before " + passage), (2002, "mid " + passage[7:180] + " dle"), (2003, "q" * 777), (2004, "q" * 99), (2005, None), (2006, ""), (2007, long), (2008, long[300:]), (2009, passage[:100]), (None, passage)]
    data.sort(key=lambda x: (x[0] is not None, x[0]))
    want = [(i, *x) for (i, _), x in zip(data, suffixes.brute_force([(t or "").encode() for _, t in data]), strict=True)]
    assert run(spark, data) == want
    for options in ({"hot": 2}, {"hot": 5}, {"hot": 2, "hot_broadcast": 0}, {"hot": 5, "hot_broadcast": 0}):
        assert run(spark, data, **options) == want
    assert sum(x[2] for x in want) > 5000


def test_repeated_rows_and_empty_table(spark):
    text = "the same text in two rows of one id, one of which loses all of it because rows of an id have an order of their own"
    got = run(spark, [(1, text), (1, text), (2, "other")])
    assert sorted(x[2] for x in got) == [0, 0, len(text)]
    assert run(spark, []) == []


def test_blind_tries_order_long_common_prefixes():
    """Many strings that agree far beyond the shallow depth and differ at places of their own."""
    random = np.random.default_rng(3)
    base = random.integers(0, 256, 100).astype(np.uint8)
    strings = []
    for _ in range(600):
        one = base.copy()
        for at in random.choice(np.arange(24, 100), random.integers(0, 3), replace=False):
            one[at] = random.integers(0, 4)
        strings.append(one.tobytes())
    data, starts = np.frombuffer(b"".join(strings), np.uint8), np.arange(600) * 100
    place = {x: k for k, x in reversed(list(enumerate(sorted(strings))))}
    assert suffixes.suffix_ranks(data, starts, 100).tolist() == [place[x] for x in strings]
    assert suffixes.suffix_ranks(data[:0], starts[:0], 100).tolist() == []


def test_one_anchor_with_many_contexts(spark):
    """A short passage before 20,000 different continuations, half of which come twice."""
    passage = "a passage that stands before many different continuations and holds the least hash of them all maybe "
    data = [(k, f"{k % 15_000:06d} own words {passage}{k % 10_000:06d} and then something else that goes on for a while, for long enough to make strings of its own {k % 10_000:06d}") for k in range(20_000)]
    want = [(i, *x) for (i, _), x in zip(data, suffixes.brute_force([t.encode() for _, t in data]), strict=True)]
    for options in ({}, {"hot_broadcast": 0}, {"hot": 1 << 40}):
        assert run(spark, data, **options) == want


def test_columns_of_any_name_are_kept(spark):
    text = "the same words of a text that is longer than a hundred bytes, so that the second row loses all of it, of course"
    df = spark.createDataFrame([(1, text, 5), (2, text, 6)], "doc_id long, text string, _rid int").selectExpr("_rid", "text", "doc_id", "7 as _first", "8 as _begin", "9 as _end", "10 as _id", "11 as _text", "12 as `a.b`", "13 as _kept")
    made = suffixes.without_repeats(df)
    assert made.columns == df.columns
    assert sorted((r._rid, r._first, r._id, r["a.b"], r._kept.n_removed) for r in made.collect()) == [(5, 7, 10, 12, 0), (6, 7, 10, 12, len(text))]
