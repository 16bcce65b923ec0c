"""The near-copy stage against brute-force Jaccard similarity."""

import random

import numpy as np

import corpus_pipeline
from quern.llm import jaccard, simhash


def brute_kept(docs):
    """Smallest doc_id of each component of pairs with 5-word Jaccard similarity of 0.8 or more."""
    sets = {}
    for i, text in docs:
        words = (text or "").encode().lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
    parent = {i: i for i, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    order = sorted(sets)
    for i in order:
        for j in order:
            if i < j and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                low, high = sorted((find(i), find(j)))
                parent[high] = low
    return sorted({find(i) for i in sets})


def test_near_dedup_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert got == brute_kept(rows)
    assert {2, 1} <= set(got) and not {56, 255} & set(got)


def test_chains_and_limits(spark):
    """A chain whose ends differ, a pair just at 0.8 and one just below, texts without words."""
    chance = random.Random(1)
    words = [f"w{k}" for k in range(400)]
    rows, at = [], list(words)
    for i in range(40):
        rows.append((i, " ".join(at)))
        at[chance.randrange(400)] = f"x{i}"
    plain = [f"p{k}" for k in range(13)]
    rows += [(100, " ".join(plain)), (101, " ".join([*plain[:-1], "other"])), (102, " ".join(plain[:-1])), (103, " ".join(plain[:-2]))]
    rows += [(200, ""), (201, None), (202, " \n"), (203, "one"), (204, "ONE ")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert got == brute_kept(rows)
    exact = [(a, len(set(jaccard.shingles(t).tolist()))) for a, t in rows[40:44]]
    assert exact == [(100, 9), (101, 9), (102, 8), (103, 7)]


def test_sketches_never_tell_similar_sets_apart():
    """They differ in no more bits than the sets in shingles, and tell most dissimilar sets apart."""
    chance = np.random.default_rng(5)
    pruned = 0
    for _ in range(200):
        size, changed = int(chance.integers(1, 400)), int(chance.integers(0, 120))
        a = np.unique(chance.integers(0, 1 << 63, size, dtype=np.uint64))
        b = np.unique(np.append(a[min(changed, len(a)) :], chance.integers(0, 1 << 63, changed, dtype=np.uint64)))
        bits = int(np.bitwise_count((jaccard.sketch(a) ^ jaccard.sketch(b)).view(np.uint64)).sum())
        apart = len(np.setxor1d(a, b))
        assert bits <= apart
        similar = 10 * len(np.intersect1d(a, b)) >= 8 * len(np.union1d(a, b))
        kept = (100 + jaccard.PERCENT) * bits <= (100 - jaccard.PERCENT) * (len(a) + len(b))
        assert kept or not similar
        pruned += not kept
    assert pruned > 50


def test_wide_sketches_of_any_two_sizes(spark):
    """Similar sets are never told apart, whatever their sizes; others are, however long they are."""
    chance, rows = np.random.default_rng(6), []
    for size in (1, 3, 100, 127, 128, 129, 140, 1000, 1025, 5000):
        a = np.unique(chance.integers(0, 1 << 63, size, dtype=np.uint64))
        for changed in {0, size // 20, size // 9, size // 2, size}:
            for more in (0, size // 8, 2 * size):
                b = np.unique(np.concatenate([a[changed:], chance.integers(0, 1 << 63, changed + more, dtype=np.uint64)]))
                similar = 10 * len(np.intersect1d(a, b)) >= 8 * len(np.union1d(a, b))
                rows.append((jaccard.wide_sketch(a).tolist(), jaccard.wide_sketch(b).tolist(), len(np.setxor1d(a, b)), len(a) + len(b), similar))
    found = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>, apart long, total long, similar boolean")
    pruned = 0
    for r in found.select("apart", "total", "similar", jaccard.differing(found.a, found.b).alias("bits")).collect():
        assert r.bits is None or r.bits <= r.apart
        kept = r.bits is not None and 180 * r.bits <= 20 * r.total
        assert kept or not r.similar
        pruned += not kept
    assert pruned > 60 and any(r[4] for r in rows)


def test_only_sets_that_may_be_similar_travel(spark, monkeypatch):
    """Long texts that share a passage, and one near copy: two whole sets are compared, not all."""
    chance = random.Random(3)
    passage = " ".join(f"c{k}" for k in range(500))
    rows = [(i, " ".join([*(f"w{chance.randrange(10**9)}" for _ in range(1500)), passage])) for i in range(30)]
    rows.append((30, rows[7][1] + " " + " ".join(f"e{k}" for k in range(100))))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    sets, before = [], jaccard.staged

    def staged(df, name, **how):
        made = before(df, name, **how)
        if name == "jaccard-sets":
            sets.append(made.count())
        return made

    monkeypatch.setattr(jaccard, "staged", staged)
    found = jaccard.near_copies(docs, sample=0).collect()  # no shingle is known to be frequent, so passages meet
    groups = {}
    for r in found:
        groups.setdefault(r.component, []).append(r.doc_id)
    assert sorted(min(x) for x in groups.values()) == brute_kept(rows) == list(range(30))
    assert sum(sets) == 2


def test_fingerprints_link_first(spark, monkeypatch):
    """Near copies of few differing bits are found by op3's vantage trees over SimHash fingerprints."""
    text = [f"w{k}" for k in range(1000)]
    rows = [(1, " ".join(text)), (2, " ".join([*text[:-6], "other"])), (3, "apart " * 9)]
    prints = [simhash.majority(jaccard.shingles(t)) for _, t in rows]
    assert 1 <= (prints[0] ^ prints[1]).bit_count() <= 3 < (prints[0] ^ prints[2]).bit_count()
    linked, before = [], jaccard.near_links

    def near_links(nodes, radius):
        made = before(nodes, radius)
        linked.extend({r.a, r.b} for r in made.collect())
        return made

    monkeypatch.setattr(jaccard, "near_links", near_links)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [1, 3]
    assert linked and all({x % (1 << 64) for x in pair} == set(prints[:2]) for pair in linked)
