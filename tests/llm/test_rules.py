"""Operators 1, 2, 6, 7 and 9 against brute force."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import public_tokenizers as P
import pytest

from quern.llm import audio, bpe, chat, quality, queries, rollups, urls

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


# chat


def brute_chat(rows):
    of = defaultdict(list)
    for conv, turn, role, text in rows:
        of[conv].append((turn is not None, turn or 0, role is not None, role or "", text or ""))
    out = []
    for conv, turns in of.items():
        turns.sort()
        loss = "".join(t for *_, role, t in turns if role == "assistant")
        out.append((conv, len(turns), digest("".join(f"{r}\n{t}\n" for *_, r, t in turns)), len(loss), digest(loss)))
    return sorted(out, key=str)


NASTY = [
    (-7, 0, "user", "\\### Assistant: </turn> ok"),
    (-7, 1, "assistant", "\\### Assistant: </turn> ok"),
    (1, 2, "assistant", "</turn>\n### user:\n\\\\/ #### ##### <\\/turn> \\"),
    (1, 1, "odd: role\n\\", "x" * 3000 + "é𝄞" * 700),
    (1, 2, "assistant", None),
    (1, 2, "assistant", ""),
    (1, 2, "assistant", "same"),
    (1, 2, "assistant", "same"),
    (2, None, None, "null turn"),
    (None, 0, "assistant", "null conversation 𝄞"),
]


def test_chat(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()] + NASTY
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as seq", "'x' as kind", "2 as start", "3 as place")
    got = sorted((tuple(r)[:5] for r in chat.digests(df).collect()), key=str)
    assert got == brute_chat(rows)
    assert chat.digests(df.limit(0)).count() == 0


def test_chat_masks_and_control_strings(spark):
    df = spark.createDataFrame(NASTY, "conv_id long, turn long, role string, text string")
    rendered = chat.render(chat.fold(chat.as_events(df)))
    for r in rendered.collect():
        bodies = r.formatted.split(chat.TURN_END)
        assert all("</turn>" not in b and "###" not in b[4:] for b in bodies)
        for span in r.loss_spans:
            assert r.formatted[: span.start].endswith("### assistant:\n") and r.formatted[span.start + span.length :].startswith("</turn>\n")
        assert len(r.loss_spans) == sum(1 for x in NASTY if x[0] == r.conv_id and x[2] == "assistant")


def test_chat_folds_events(spark):
    log = [
        (1, 1, "message", 0, "user", "hi"),
        (1, 2, "message", 1, "assistant", ""),
        (1, 3, "delta", 1, "assistant", "wrong "),
        (1, 4, "delta", 1, "assistant", "answer"),
        (1, 5, "regenerate", 1, "assistant", None),
        (1, 7, "delta", 1, "assistant", "answer"),
        (1, 6, "delta", 1, "assistant", "right "),
        (1, 8, "message", 2, "user", "next"),
        (1, 9, "message", 3, "assistant", "gone"),
        (1, 10, "edit", 2, "user", "edited"),
        (1, 11, "delta", 3, "assistant", "new"),
        (2, None, None, None, None, None),
        (2, 5, "delta", 0, "assistant", "only a delta"),
        (3, 1, "message", 0, "user", "a"),
        (3, 1, "delta", 0, None, "b"),
        (3, 1, "delta", 0, None, "b"),
        (4, 1, "message", 0, "user", "x"),
        (4, 2, "message", 1, "assistant", "dropped whole"),
        (4, 3, "edit", 0, "user", "y"),
    ]
    got = {(r.conv_id, r.turn): (r.role, r.text) for r in chat.fold(spark.createDataFrame(log, chat.EVENTS)).collect()}
    assert got == {(1, 0): ("user", "hi"), (1, 1): ("assistant", "right answer"), (1, 2): ("user", "edited"), (1, 3): ("assistant", "new"), (2, None): (None, ""), (2, 0): ("assistant", "only a delta"), (3, 0): ("user", "abb"), (4, 0): ("user", "y")}


# quality


def brute_measures(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    inside = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def test_quality_measures(spark):
    texts = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    texts += [None, "", " \n\t", "a b c", "a b c a b c", "a a a a a a", "x y z " * 400 + "end", "l\nl\n \n\nl\r\nl", "#|<>&%$* é𝄞\x1c \x85 w", "a b a b c a b\n" * 3]
    df = spark.createDataFrame([(i, t, "en", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, n_words int")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.verdicts(df).collect()}
    for i, text in enumerate(texts):
        want = brute_measures(text)
        assert got[i] == (*want, want[0] < 50 or 100 * want[4] > 50 * want[0]), text


def brute_distances(documents):
    """Distances of (text, lang) rows by the definition in quality.judged."""

    def shape(t):
        symbols = sum(c in "#*$%&|<>" for c in t)
        upper, digits = sum(c.isupper() for c in t), sum(c.isdigit() for c in t)
        spaces = sum(c in " \t\n\x0b\x0c\r" for c in t)
        marks = sum(not c.isalnum() and c not in "#*$%&|<> \t\n\x0b\x0c\r" for c in t)
        return np.array([upper, digits, symbols, spaces, marks, len(t) - upper - digits - symbols - spaces - marks], float)

    def spoken(t):
        return [x for x in re.sub(r"[\W\d_]+", " ", t.lower()).split(" ") if x]

    def js(p, q):
        p, q = np.append(p, max(0, 1 - p.sum())), np.append(q, max(0, 1 - q.sum()))
        part = lambda x, y: np.where(x > 0, x * np.log2(np.where(x > 0, 2 * x / np.maximum(x + y, 1e-300), 1)), 0)
        return math.sqrt(max(0, (part(p, q) + part(q, p)).sum() / 2))

    sizes = Counter()
    for t, lang in documents:
        sizes[lang] += len(WORD.findall(t))
    own = {x for x, n in sizes.items() if x is not None and n >= quality.LANGUAGE_WORDS}
    shapes, counts, total = defaultdict(lambda: np.zeros(6)), defaultdict(Counter), Counter()
    for t, lang in documents:
        for key in {lang if lang in own else None, None}:
            shapes[key] += shape(t)
            counts[key].update(spoken(t))
            total[key] += len(WORD.findall(t))
    out = []
    for t, lang in documents:
        key = lang if lang in own else None
        top = [(w, c) for w, c in counts[key].items() if 1000 * c >= quality.COMMON_PERMILLE * total[key]]
        n, mine = len(WORD.findall(t)), Counter(spoken(t))
        a = js(shape(t) / len(t), shapes[key] / shapes[key].sum()) if len(t) >= 200 else None
        b = js(np.array([mine[w] for w, _ in top]) / n, np.array([c for _, c in top]) / total[key]) if n >= 50 else None
        out.append((a, b))
    return out


def test_quality_distances(spark):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()] + [(900, "mot " * 300, None), (901, "ein wort " * 99, "xx")]
    got = {r.doc_id: r for r in quality.verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for (i, _, _), (a, b) in zip(rows, brute_distances([(t, x) for _, t, x in rows]), strict=True):
        assert got[i].class_distance == pytest.approx(a, abs=1e-6) and got[i].word_distance == pytest.approx(b, abs=1e-6)
        assert got[i].kept == (not got[i].base_failed and not (a or 0) > 0.30 and not (b or 0) > 0.35)


def test_quality_keeps_good_documents_and_drops_bad_ones(spark):
    folder = "/root/testdata/sf0.01"
    marked = quality.verdicts(spark.read.parquet(f"{folder}/documents.parquet")).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    good = [r.kept for r in marked if r.quality == 1 and not r.base_failed]
    bad = [r.kept for r in marked if r.quality == 0]
    assert all(good) and len(good) > 250 and sum(bad) < 0.25 * len(bad)


def test_quality_keeps_columns_of_any_name(spark):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    clash = plain.selectExpr("*", "1 as _lang", "2 as _words", "3 as _a", "4 as _measured", "5 as _kept", "6 as pattern", "7 as n_words", "8 as _quality", "9 as _verdict")
    assert quality.judged(clash).where("_lang = 1 and _a = 3 and _measured = 4 and pattern = 6 and _verdict = 9").count() == len(rows)
    kept = quality.accepted(clash)
    assert kept.columns == clash.columns and sorted(r.doc_id for r in kept.where("_kept = 5 and _quality = 8").collect()) == sorted(r.doc_id for r in quality.accepted(plain).collect())


def test_quality_with_many_languages(spark, monkeypatch):
    """700 languages with references of their own, each of one long word and many rare ones."""
    monkeypatch.setattr(quality, "LANGUAGE_WORDS", 400)
    rows = [(k, f"sonderbarkeit{'abcdefghij'[k % 10] * (k // 10 + 1)} " * 200 + " ".join(f"w{j}" for j in range(220)), f"l{k}") for k in range(700)]
    own = [(2000 + k, rows[k][1], f"l{k}") for k in (0, 350, 699)]
    other = [(3000 + k, rows[k][1], f"l{k + 1}") for k in (0, 350, 698)]
    df = spark.createDataFrame(rows + own + other, "doc_id long, text string, lang string")
    refs = {r.lang: r for r in quality.references(df).collect()}
    assert len(refs) == 701 and all(any(len(w) > 13 for w in r.words) for lang, r in refs.items() if lang)
    got = {r.doc_id: r.word_distance for r in quality.verdicts(df).collect()}
    assert all(got[i] < 0.35 for i, _, _ in own) and all(got[i] > 0.35 for i, _, _ in other)


def test_quality_of_odd_tables(spark):
    schema = "doc_id long, text string, lang string"
    assert quality.verdicts(spark.createDataFrame([], schema)).count() == 0
    odd = quality.verdicts(spark.createDataFrame([(None, None, None), (1, "", "*"), (1, "", "*")], schema)).collect()
    assert len(odd) == 3 and not any(r.kept for r in odd)


# rollups


def rollup_rows(spark, rows):
    return spark.createDataFrame(rows, "source string, lang string, tokenizer string, n_tokens long, n_chars long")


def test_rollups_add_up(spark, tmp_path):
    random = np.random.default_rng(0)
    rows = [(f"s{random.integers(3)}" if k % 7 else None, "en", f"v{k % 2}", int(random.integers(100)) if k % 11 else None, k) for k in range(200)]

    def want(live):
        out = defaultdict(lambda: [0, 0, 0])
        for s, lang, v, n, c in live:
            for k, x in enumerate((1, n or 0, c)):
                out[s, lang, v][k] += x
        return sorted(((*k, *v) for k, v in out.items()), key=str)

    def have(rollup):
        return sorted(map(tuple, rollup.totals().collect()), key=str)

    rollup = rollups.TokenRollup(spark, str(tmp_path / "r"))
    assert have(rollup) == []
    assert rollup.commit("one", inserts=rollup_rows(spark, rows[:150])) and have(rollup) == want(rows[:150])
    assert not rollup.commit("one", inserts=rollup_rows(spark, rows[:150])) and have(rollup) == want(rows[:150])
    assert rollup.commit("two", inserts=rollup_rows(spark, rows[150:]), deletes=rollup_rows(spark, rows[:60]))
    revised = [(s, lang, "v9", (n or 0) + 5, c) for s, lang, _, n, c in rows[60:100]]
    again = rollups.TokenRollup(spark, str(tmp_path / "r"))
    assert again.commit("three", revisions=(rollup_rows(spark, rows[60:100]), rollup_rows(spark, revised)))
    assert have(again) == want(rows[100:] + revised)
    again.commit("four", deletes=rollup_rows(spark, rows[100:] + revised))
    again.commit("five")
    assert have(again) == []


def test_rollups_of_many_batches_are_compacted(spark, tmp_path):
    rollup = rollups.TokenRollup(spark, str(tmp_path / "r"))
    for k in range(12):
        assert rollup.commit(f"b{k}", inserts=rollup_rows(spark, [("s", "en", "v", k, 1)]))
    assert len(rollup.layers) <= rollups.LAYERS and [tuple(r) for r in rollup.totals().collect()] == [("s", "en", "v", 12, 66, 12)]
    assert not rollup.commit("b3", inserts=rollup_rows(spark, [("s", "en", "v", 3, 1)]))


def test_racing_rollups_both_count_once(spark, tmp_path):
    one, two = (rollups.TokenRollup(spark, str(tmp_path / "r")) for _ in range(2))
    with ThreadPoolExecutor(4) as pool:
        done = list(pool.map(lambda x: x[0].commit(x[1], inserts=rollup_rows(spark, [("s", "en", "v", 1, 1)])), [(one, "a"), (two, "a"), (rollups.TokenRollup(spark, str(tmp_path / "r")), "b")]))
    assert done[2] and sorted(done[:2]) == [False, True]
    assert [tuple(r) for r in rollups.TokenRollup(spark, str(tmp_path / "r")).totals().collect()] == [("s", "en", "v", 2, 2, 2)]


def test_rollup_query(spark, tmp_path):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = defaultdict(lambda: [0, 0, 0])
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        for k, x in enumerate((1, len(plain.encode_ordinary(r.text)), len(r.text))):
            want[r.source, r.lang, "byte_bpe_50k"][k] += x
    got = queries.QUERIES["op7_token_rollups"](spark, SMALL).collect()
    assert {tuple(r)[:3]: list(r)[3:] for r in got} == dict(want)
    empty = spark.createDataFrame([], "source string, lang string, text string")
    assert rollups.retokenized(empty, str(tmp_path / "e"), bpe.ByteBpe(spark, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)).count() == 0


# urls


def brute_url(url):
    found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda m: m[0].lower(), found[1]), found[2]) if found else ("", "")
    fit = [(len(text), text, verdict) for verdict, text in urls.RULES if (host == text.split("/")[0] or host.endswith("." + text.split("/")[0])) and path.startswith(text[text.index("/") :])]
    return host, path, *(max(fit)[1:] if fit else (None, None))


def test_url_rules(spark):
    data = [(r.page_id, r.url) for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()]
    data += [(900, None), (901, ""), (902, "no scheme/en/"), (903, "HTTP://A.Example.COM/en/7?x"), (904, "http://com/en/"), (905, "x://example.com/en/6://y.net/de/8#z"), (906, "http://"), (907, "http://aexample.net/de/8\nq"), (907, "http://É.example.net:80/de/81#"), (None, "https://sub.org/es"), (908, "http://" + "a" * 20000 + ".com/" + "b/" * 9000)]
    df = spark.createDataFrame([(i, u, "<p>some words of a page</p>") for i, u in data], "page_id long, url string, html string").selectExpr("*", "1 as host", "'r' as rule", "2 as verdict")
    got = urls.verdicts(df).collect()
    of = {(r.page_id, r.host, r.path): r for r in got}
    assert len(got) == len(data)
    for i, url in data:
        host, path, rule, verdict = brute_url(url)
        r = of[i, host, path]
        assert r.rule == rule and r.verdict in ("allow", "block") and (verdict is None or r.verdict == verdict)
    assert urls.verdicts(df.limit(0)).count() == 0


def brute_segment(name, unigrams):
    best = None
    for cut in range(1 << max(0, len(name) - 1)):
        words, start = [], 0
        for k in range(1, len(name) + 1):
            if k == len(name) or cut >> (k - 1) & 1:
                words.append(name[start:k])
                start = k
        cost = sum(map(unigrams.cost, words))
        if best is None or cost < best[0] - 1e-9:
            best = cost, words
    return best


def test_segmentation_is_the_cheapest():
    unigrams = urls.Unigrams.of(Counter({"cheap": 9, "pills": 7, "a": 30, "he": 12, "cheappi": 1, "lls": 1, "win": 5}))
    for name in ("cheappills", "ahewin", "hecheapx", "zzz", "a", "winwinwin"):
        words = unigrams.segment(name)
        assert "".join(words) == name and sum(map(unigrams.cost, words)) == pytest.approx(brute_segment(name, unigrams)[0])
    assert unigrams.segment("cheappills") == ["cheap", "pills"] and unigrams.segment("") == []


def test_classifier_on_names_it_has_not_seen(spark):
    model = urls.train(urls.word_counts(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")))
    bad = ["cheappillsnow.example.com", "www.casinowinbig.net", "adultx.org", "hotxxxcams.com", "freebets.example.net", "spamfarm.example.org", "adstrack.com", "m.ads-track.example.com", "blog.casino-win.example.net"]
    good = ["city-news.example.com", "blog.ththan.example.net", "opensciencejournal.org", "weathertoday.com", "booklibrary.example.org", "gardenrecipes.net", "therti.example.org"]
    assert [model.verdict(x, "/") for x in bad] == ["block"] * len(bad)
    assert [model.verdict(x, "/en/12") for x in good] == ["allow"] * len(good)


# audio


def test_integral_filters_match_plain_sums():
    frames = np.random.default_rng(0).random((40, audio.CHROMA))
    got = audio.fingerprint(frames)
    assert len(got) == 40 - audio.WIDTH + 1
    for t in (0, 7, 24):
        item = 0
        for kind, low, height, width in audio.FILTERS:
            box = frames[t : t + width, low : low + height]
            h, w, th, tw = height // 2, width // 2, max(1, height // 3), max(1, width // 3)
            whole = box.sum()
            if kind == 0:
                value = (whole * 12 / frames[t : t + width].sum() / height - 1) / 5
            else:
                part = [None, box[:, h:].sum(), box[w:].sum(), box[:w, h:].sum() + box[w:, :h].sum(), box[:, th : height - th].sum(), box[tw : width - tw].sum()][kind]
                value = 2 * part / whole - 1
            level = int(value > -0.1) + int(value > 0) + int(value > 0.1)
            item = item << 2 | (level ^ level >> 1)
        assert got[t] == item


def test_chroma_matches_a_plain_transform():
    """Frames by the sums of the discrete Fourier transform, pitch classes by their frequencies."""
    random = np.random.default_rng(5)
    t = np.arange(audio.FRAME + 2 * audio.HOP)
    samples = 0.4 * np.sin(2 * np.pi * 440 * t / audio.RATE) + 0.3 * np.sin(2 * np.pi * 523.25 * t / audio.RATE) + random.normal(0, 0.01, len(t))
    got = audio.chroma(samples, audio.RATE)
    assert got.shape == (3, audio.CHROMA) and got.sum(0).argsort()[-2:].tolist() in ([3, 0], [0, 3])
    n = np.arange(audio.FRAME)
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * n / (audio.FRAME - 1))
    for k in range(3):
        frame = samples[k * audio.HOP : k * audio.HOP + audio.FRAME] * taper
        energy = np.zeros(audio.CHROMA)
        for f in range(audio.FRAME // 2 + 1):
            hertz = f * audio.RATE / audio.FRAME
            if audio.LOWEST <= hertz <= audio.HIGHEST:
                energy[round(12 * math.log2(hertz / 440.0)) % 12] += abs((frame * np.exp(-2j * np.pi * f * n / audio.FRAME)).sum()) ** 2
        assert got[k] == pytest.approx(energy / math.sqrt((energy**2).sum()), abs=1e-9)
    assert audio.chroma(np.zeros(5000), audio.RATE).sum() == 0 and len(audio.chroma(samples[:100], audio.RATE)) == 0


def test_runs_of_keys_vote_like_their_frames(spark):
    """Steady tones: the offset of most votes is that of counting every pair of frames, ties included."""
    random = np.random.default_rng(8)
    items = {k: np.repeat(random.integers(0, 3, 8), random.integers(1, 12, 8)).astype("<u4") for k in range(6)}
    df = spark.createDataFrame([(k, v.tobytes()) for k, v in items.items()], "class_id long, items binary")
    got = {(r.query, r.match): r.offset for r in audio.align(df, df, most_errors=1.0, least_overlap=0).collect()}

    def keys(x):
        room = max(0, len(x) - 2 * audio.STRIDE)
        half = lambda k: [tuple((int(x[k + j * audio.STRIDE]) >> s) & 0xFFFF for j in range(3)) for s in (16, 0)]
        return [(tag, key, k) for k in range(room) for tag, key in enumerate(half(k))]

    for a, x in items.items():
        for b, y in items.items():
            votes = Counter(j - i for s, p, i in keys(x) for t, q, j in keys(y) if s == t and sum((m ^ n).bit_count() for m, n in zip(p, q, strict=True)) <= 1)
            if a != b and votes:
                assert got[a, b] == min(votes, key=lambda o: (-votes[o], o))


def test_recall_on_a_whole_table(spark):
    """The table's queries against all its rows, and against four noisy copies of each, at all offsets.
    (Without the copies, brute force finds no alignment in the table, and the query none either.)"""
    random = np.random.default_rng(9)
    data = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    data += [(100_000 + 20 * i + k, (np.array(v) + random.normal(0, 0.001 * 2**k, len(v))).tolist()) for i, v in data if i % 20 == 0 for k in range(1, 5)]
    found = audio.search(spark.createDataFrame(data, "vec_id long, embedding array<double>"), "vec_id", "embedding", audio.sonify)
    got = {(r.id, r.match) for r in found.collect() if r.match is not None}
    prints = {i: audio.fingerprint(audio.chroma(*audio.sonify(v))) for i, v in data}
    first = {}
    for i in sorted(prints):
        first.setdefault(prints[i].tobytes(), i)
    want = set()
    for i in (i for i in prints if i % 20 == 0):
        a, own = prints[i], first[prints[i].tobytes()]
        for j in first.values():
            b = prints[j]
            if j != own and any(np.bitwise_count(x ^ y).sum(dtype=int) <= 0.125 * 32 * len(x) for s in range(-31, 32) for x, y in [(a[max(0, -s) : len(b) - s], b[max(0, s) : len(a) + s])] if len(x) >= 16):
                want.add((i, j))
    recall = len(got & want) / len(want)
    print(f"op2 recall on sf0.01 with noisy copies: {recall:.4f} of {len(want)} alignments; {len(got - want)} more that brute force does not find")
    assert len(want) >= 50 and recall >= 0.9 and got <= want


def recordings(spark):
    random = np.random.default_rng(3)
    songs = [random.normal(0, 0.2, 96).tolist() for _ in range(6)]
    clean = [audio.sonify(x)[0] for x in songs]
    rows = [(20 * k, audio.encode_wav(x)) for k, x in enumerate(clean)]
    rows += [(101, audio.encode_wav(clean[0])), (102, audio.encode_wav(clean[1][audio.HOP * 20 :])), (103, audio.encode_wav(clean[2] + random.normal(0, 0.02, len(clean[2])))), (104, b"junk"), (105, None), (106, b""), (None, audio.encode_wav(clean[3])), (107, audio.encode_wav(np.zeros(60000))), (107, audio.encode_wav(np.zeros(60000)))]
    return spark.createDataFrame(rows, "rec long, sound binary").selectExpr("*", "1 as id", "'x' as items", "2 as key", "3 as match")


def test_alignment(spark):
    got = audio.search(recordings(spark), "rec", "sound").collect()
    of = defaultdict(dict)
    for r in got:
        if r.match is not None:
            of[r.id][r.match] = r
    assert sorted({r.id for r in got if r.id is not None}) == sorted({0, 20, 40, 60, 80, 100, 101, 102, 103, 104, 105, 106, 107})
    assert {r.class_id for r in got if r.id == 101} == {0} and len([r for r in got if r.id == 107]) == 2
    assert of[20].keys() == {102} and of[20][102].offset == -20 and of[20][102].bit_errors <= 0.02 * 32 * of[20][102].overlap
    assert of[40].keys() == {103} and of[40][103].offset == 0
    assert not of[60] and not of[80]
    assert audio.search(recordings(spark).limit(0), "rec", "sound").count() == 0


def test_search_finds_what_brute_force_finds(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    random = np.random.default_rng(4)
    data = [(r.vec_id, r.embedding) for r in rows[:120]] + [(1000 + k, (np.array(rows[20 * (k % 6)].embedding) + random.normal(0, 0.002, 64)).tolist()) for k in range(60)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = {(r.id, r.match) for r in audio.search(df, "vec_id", "embedding", audio.sonify).collect() if r.match is not None}
    prints = {i: audio.fingerprint(audio.chroma(*audio.sonify(v))) for i, v in data}
    want = set()
    for i, a in prints.items():
        for j, b in prints.items():
            if i % 20 == 0 and i != j and any(len(x) >= 16 and np.bitwise_count(x ^ y).sum(dtype=int) <= 0.125 * 32 * len(x) for s in range(-31, 32) for x, y in [(a[max(0, -s) : len(a) - max(0, s)], b[max(0, s) : len(b) - max(0, -s)])]):
                want.add((i, j))
    assert want and len(got & want) >= 0.9 * len(want) and got <= want


@pytest.mark.parametrize("name", ["op1", "op2", "op6", "op7", "op8", "op9"])
def test_queries_run(spark, name):
    query = next(f for k, f in queries.QUERIES.items() if k.startswith(name + "_"))
    assert query(spark, SMALL).count() >= 20
