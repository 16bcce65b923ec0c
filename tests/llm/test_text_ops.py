"""Operators 3, 4, 5 and 10 against brute force."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

from quern.llm import bpe, lines, packing, queries, simhash
from quern.llm.components import components

SMALL = "/root/testdata/sf0.001"
ODD = [
    (1, "Alpha beta gamma.\nSame line\nalpha"),
    (2, None),
    (3, ""),
    (4, " \t leading\x0bblank  two  blanks \n\n tail "),
    (5, "É ÉÈ   x y \x1c z \x85 q don't can't 12345 ### !!"),
    (6, "a" * 5000 + " " * 3000 + "\n" * 50 + "b c d e f " * 9000),
    (6, "a repeated id"),
    (7, "Alpha beta gamma.\nSame line\nalpha"),
    (None, "Alpha beta gamma.\nSame line\nalpha"),
]


def rows(spark, data, clash=False):
    df = spark.createDataFrame(data, "doc_id long, text string")
    if clash:
        df = df.selectExpr("*", "1 as fp", "'x' as ids", "2 as n_lines", "'k' as key", "3 as component", "4 as a", "'e' as source")
    return df


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def coder(spark):
    return bpe.ByteBpe(spark, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def plain_encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_round_trip(spark, coder):
    plain = plain_encoding()
    data = documents(spark)[:80] + ODD
    got = sorted(map(tuple, bpe.digests(rows(spark, data, True), coder).select("n_tokens", "ids_sha256", "decoded_sha256").collect()))
    want = []
    for _, text in data:
        ids = plain.encode_ordinary(text or "")
        want.append((len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.digests(rows(spark, []), coder).count() == 0


def test_bpe_safe_boundaries():
    plain = plain_encoding()
    for _, text in ODD:
        text = (text or "") * 3
        pieces = list(bpe.parts(text, 7))
        assert "".join(pieces) == text
        assert [i for p in pieces for i in plain.encode_ordinary(p)] == plain.encode_ordinary(text)


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(fps):
    least = {}
    for doc_id, fp in fps:
        least[fp] = min(x for x in (doc_id, least.get(fp)) if x is not None) if doc_id is not None or least.get(fp) is not None else None
    keys = list(least)
    parent = {k: k for k in keys}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (a ^ b).bit_count() <= 3:
                parent[find(a)] = find(b)
    best = {}
    for k in keys:
        if least[k] is not None:
            best[find(k)] = min(best.get(find(k), least[k]), least[k])
    return {k: best.get(find(k)) for k in keys}


def test_simhash(spark):
    data = documents(spark) + [(1000 + i if i is not None else None, t) for i, t in ODD]
    got = sorted(map(tuple, simhash.digests(rows(spark, data, True)).collect()), key=str)
    fps = [(i, brute_fingerprint(t)) for i, t in data]
    of = brute_components(fps)
    assert got == sorted([(i, f"{fp:016x}", of[fp]) for i, fp in fps], key=str)
    assert simhash.digests(rows(spark, [])).count() == 0
    kept = simhash.keep_one(rows(spark, data, True)).collect()
    assert {x.doc_id for x in kept} == set(of.values())
    both = [(6, "one text of a repeated id"), (6, "and quite another one with words of its own"), (6, "one text of a repeated id"), (None, "nobody's own text"), (None, None)]
    assert sorted((x.doc_id or 0, x.text or "") for x in simhash.keep_one(rows(spark, both)).collect()) == sorted({(i or 0, t or "") for i, t in both})


def test_components_of_random_graphs(spark):
    random = np.random.default_rng(12)
    edges = [(int(a), int(b)) for a, b in random.integers(0, 60, (45, 2))] + [(100 + k, 101 + k) for k in range(40)] + [(300, 200), (301, 200), (300, 200), (None, 7), (8, None), (9, 9)]
    parent = {x: x for e in edges for x in e if x is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    linked = {x for a, b in edges if a is not None and b is not None and a != b for x in (a, b)}
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_one_keeps_columns_of_any_name(spark):
    df = rows(spark, [(2, "some words of a text"), (1, "some words of a text"), (3, "quite other words, which are alone")]).selectExpr("5 as _key", "*", "6 as _crc", "7 as component", "8 as _fp")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted((r._key, r.doc_id, r._crc, r.component, r._fp) for r in kept.collect()) == [(5, 1, 6, 7, 8), (5, 3, 6, 7, 8)]


def test_block_links_join_all_close_points():
    random = np.random.default_rng(4)
    base = random.integers(0, 1 << 63, 30, dtype=np.uint64)
    points = np.unique(base[random.integers(0, 30, 900)] ^ (np.uint64(1) << random.integers(0, 64, 900).astype(np.uint64)) ^ (np.uint64(1) << random.integers(0, 64, 900).astype(np.uint64)))
    points = random.permutation(points)
    for block in (2048, 100):
        left, right = simhash._block_links(points, 3, block)
        parent = list(range(len(points)))

        def find(x, parent=parent):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in zip(left.tolist(), right.tolist(), strict=True):
            parent[find(a)] = find(b)
        of = brute_components([(k, int(x)) for k, x in enumerate(points)])
        got, want = defaultdict(set), defaultdict(set)
        for k, x in enumerate(points.tolist()):
            got[find(k)].add(k)
            want[of[x]].add(k)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_near_links_of_clustered_fingerprints(spark):
    random = np.random.default_rng(0)
    centres = random.integers(0, 1 << 63, 40, dtype=np.uint64)
    values = {int(c) for c in centres}
    for c in centres.tolist() + [centres[0].item()] * 300 + random.integers(0, 1 << 63, 2000).tolist():
        for _ in range(3):
            flips = random.choice(64, 3)
            values.add(c ^ (1 << int(flips[0])) ^ (1 << int(flips[1])) ^ (1 << int(flips[2])))
    nodes = np.array(sorted(values), np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x, x) for x in nodes], "fp long, node long")
    edges = [(a, b) for a, b in simhash.near_links(df, leaf=200).collect()]
    want = brute_components([(k, x & (2**64 - 1)) for k, x in enumerate(nodes)])
    assert all(((a ^ b) & (2**64 - 1)).bit_count() >= 1 for a, b in edges)
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    groups, wanted = defaultdict(set), defaultdict(set)
    for x in nodes:
        groups[find(x)].add(x)
        wanted[want[x & (2**64 - 1)]].add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_vantage_tree_loses_no_pair():
    random = np.random.default_rng(1)
    base = random.integers(0, 1 << 32, 3000, dtype=np.uint64)
    tree = simhash.VantageTree(base[:500], 3000, 60, 1)
    near = base ^ (np.uint64(1) << random.integers(0, 32, 3000, dtype=np.uint64))
    leaves = [defaultdict(set), defaultdict(set)]
    for side, values in enumerate((base, near)):
        for leaf, where in tree.route(values):
            for k in where:
                leaves[side][int(k)].add(leaf)
    assert tree.leaves > 10 and all(leaves[0][k] & leaves[1][k] for k in range(3000))


def test_packing(spark):
    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    data = [(i, t) for i, t in documents(spark) + ODD[:-1] if i != 6] + [(6, ODD[5][1])]
    data = list({i: (i, t) for i, t in data}.values())
    got = packing.pack(rows(spark, data, True), P.path("byte_bpe_50k.json")).collect()
    ids = {i: own.encode(t or "", add_special_tokens=False).ids + [1] for i, t in data}
    sequences, seen = defaultdict(list), defaultdict(list)
    for r in got:
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert len(piece) == r.length > 0 and r.doc_tokens == len(ids[r.doc_id])
        assert zlib.crc32(np.array(piece, "<u4").tobytes()) == r.ids_crc32
        sequences[r.sequence_id].append((r.offset, r.length))
        seen[r.doc_id].append((r.start, r.length))
    for parts in [*sequences.values(), *seen.values()]:
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
    assert {i: sum(n for _, n in x) for i, x in seen.items()} == {i: len(x) for i, x in ids.items()}
    lengths = [sum(n for _, n in x) for x in sequences.values()]
    assert max(lengths) <= 2048 and all(n & (n - 1) == 0 for n in lengths)
    assert packing.pack(rows(spark, []), P.path("byte_bpe_50k.json")).count() == 0


def test_packing_repeats_and_null_ids(spark):
    data = [(1, "one two"), (1, "one two"), (None, "three"), (2, None)]
    got = packing.pack(rows(spark, data), P.path("byte_bpe_50k.json"), size=4).collect()
    assert Counter(r.doc_id for r in got if r.start == 0) == {1: 2, None: 1, 2: 1}


def test_word_encoder_equals_the_tokenizer():
    with open(P.path("byte_bpe_50k.json"), "rb") as file:
        definition = file.read()
    own = packing.tokenizer(definition)
    random = np.random.default_rng(6)
    parts = ["the", "don't", "We'll", "x's", "''s", "1,234.5", "É'tre", "naïve—", "日本語", "\n", "a\nb", "a\n\nb", "\t", "", "", "!!", "###", "'", "-x", "\u00a0y", "\u0085z", "\x1cq", "Ünï", "<|endoftext|>", "ǅ", "²³", "½x", "e\u0301"]
    batch = [" ".join(random.choice(parts, random.integers(0, 30))) for _ in range(800)] + [t or "" for _, t in ODD]
    want = [np.array(own.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in batch]
    for pattern in (None, P.PATTERN):
        coder = packing.WordEncoder(definition, pattern)
        assert coder.encode(pa.array(batch)) == want and coder.encode(pa.array([*batch[::-1], None]).slice(3)) == [*want[::-1], b""][3:]
        assert coder.encode(pa.array([], pa.string())) == []


def test_hilbert_curve_is_continuous():
    bits = 3
    points = np.array([(a, b) for a in range(8) for b in range(8)])
    order = points[np.argsort(packing.hilbert_key(points, bits))]
    assert len(np.unique(packing.hilbert_key(points, bits))) == 64
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def brute_lines(data, least=10):
    keys = [[line.strip(" \t\n\x0b\x0c\r").encode().lower() for line in (t or "").split("\n")] for _, t in data]
    count = Counter(k for x in keys for k in set(x) if k)
    out = []
    for (i, t), own in zip(data, keys, strict=True):
        split = (t or "").split("\n")
        kept = [line for line, k in zip(split, own, strict=True) if count[k] < least or not k]
        out.append((i, len(split), len(split) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_lines(spark, tmp_path):
    data = documents(spark) + [(1000 + k, f"  COMMON line\t\nown {k}\n\nÉ") for k in range(12)] + ODD
    index = lines.LineIndex(spark, str(tmp_path / "a"), shards=5)
    df = rows(spark, data, True)
    assert index.commit("first", inserts=df)
    assert sorted(map(tuple, lines.digests(index, df).collect()), key=str) == brute_lines(data)
    small = lines.LineIndex(spark, str(tmp_path / "a"), shards=5, broadcast_bytes=0)
    assert sorted(map(tuple, lines.digests(small, df).collect()), key=str) == brute_lines(data)
    empty = lines.LineIndex(spark, str(tmp_path / "b"))
    none = rows(spark, [])
    assert empty.commit("none", inserts=none) and lines.digests(empty, none).count() == 0


def test_lines_are_reversible(spark, tmp_path):
    data = documents(spark)[:150]
    more = [(1000 + k, f"again and again\nown {k}") for k in range(12)]
    a, b = rows(spark, data), rows(spark, more)
    index = lines.LineIndex(spark, str(tmp_path / "a"), shards=3)
    index.commit("a", inserts=a)
    before = sorted(map(tuple, index.refs().select("key", "n").collect()))
    index.commit("b", inserts=b)
    assert sorted(map(tuple, lines.digests(index, a.union(b)).collect()), key=str) == brute_lines(data + more)
    assert not index.commit("b", inserts=b)
    again = lines.LineIndex(spark, str(tmp_path / "a"), shards=3)
    again.commit("c", deletes=b)
    assert sorted(map(tuple, again.refs().select("key", "n").collect())) == before
    assert sorted(map(tuple, lines.digests(again, a).collect()), key=str) == brute_lines(data)
    with pytest.raises(ValueError):
        again.commit("d", deletes=b)


def test_cuckoo_filter():
    random = np.random.default_rng(2)
    words = random.integers(0, 1 << 63, (5000, 2), dtype=np.uint64)
    held = lines.Cuckoo.sized(3000)
    assert held.insert(words[:3000]) and held.contains(words[:3000]).all()
    assert held.contains(words[3000:]).mean() < 0.01
    assert held.delete(words[:1000]) and held.contains(words[1000:3000]).all()
    assert held.contains(words[:1000]).mean() < 0.02
    assert lines.Cuckoo.loads(held.dumps()).contains(words[1000:3000]).all()


@pytest.mark.parametrize("name", ["op3", "op4", "op5", "op10"])
def test_queries_run(spark, name):
    query = next(f for k, f in queries.QUERIES.items() if k.startswith(name + "_"))
    assert query(spark, SMALL).count() >= 200
