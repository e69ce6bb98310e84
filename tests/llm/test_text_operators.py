"""Text operators against brute force, round trips, held-out accuracy and odd inputs."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from isoloom.llm import bpe, decontam, fingerprint, html_extract, langid, license_scan, line_dedup, ngram_join, quality, sharding
from isoloom.llm.common import utf8

LOW = {i: i + 32 for i in range(65, 91)}
ODD = [(1, None, "x"), (2, "", "x"), (3, "Same Line\nother", "x"), (3, "Same Line\nother", "x"), (4, " \t\n\r", None), (5, "é ß 日本 🎉", "x"), (6, "word " * 3000, "x")]


def frame(spark, rows=ODD):
    return spark.createDataFrame(rows, "doc_id long, text string, score string")


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)


def test_bpe_equals_tiktoken(codec):
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(codec.tokens)}, special_tokens={})
    rng = random.Random(3)
    texts = ["", " ", "\n\n a", "don't I'LL", "<|endoftext|>", "日本語 🎉🎉", "▁a ▁▁", "x" * 500] + ["".join(rng.choice("aeiou nrt\néß1!' ") for _ in range(200)) for _ in range(50)]
    for t, ids in zip(texts, codec.encode_all(texts)):
        assert ids == known.encode_ordinary(t) and codec.decode(ids) == t.encode()


def test_bpe_frame(spark):
    got = bpe.encode(frame(spark), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    assert len(got) == len(ODD)
    for r in got:
        assert r["n_tokens"] == len(r["ids"]) and r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()


def test_lines(spark):
    rows = [(i, f"Common {'X' if i % 2 else 'x'} line \nown {i}\n\n", "s") for i in range(12)] + ODD
    for limit in (10**6, 0):  # broadcast and shuffle
        got = {r["doc_id"]: r for r in line_dedup.dedup_lines(frame(spark, rows).where("doc_id <> 3 OR text <> ''"), broadcast_rows=limit).collect() if r["score"] == "s"}
        assert all(got[i]["text"] == f"own {i}\n\n" and (got[i]["n_lines"], got[i]["n_dropped"]) == (4, 1) for i in range(12))
    odd = line_dedup.dedup_lines(frame(spark)).where("doc_id < 3").collect()
    assert [(r["text"], r["n_lines"], r["n_dropped"]) for r in odd] == [("", 1, 0)] * 2
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def test_license(spark):
    rows = [(1, "Hello there all\nreleased under the mit license!\nand good bye", None), (2, "MIT", None), (3, None, None)]
    got = {r["doc_id"]: r["matches"] for r in license_scan.scan_licenses(frame(spark, rows)).collect()}
    assert [(m["license"], m["line"]) for m in got[1]] == [("mit", 1)] and got[2] == [] and got[3] == []
    for n, t in itertools.product(range(1, 30), (0.5, 0.8, 1.0)):
        lo, hi = license_scan.bounds(n, t)
        for m in range(1, 100):
            assert (2 * min(n, m) / (n + m) >= t - 1e-12) == (lo <= m <= hi)


def test_license_runs(spark):
    """Licences wrapped inside a long text and inside a longer line, full texts, and all runs of small texts."""
    rng = random.Random(6)
    prose = lambda n: " ".join("".join(rng.choice("aeionrst") for _ in range(5)) for _ in range(n))
    full = license_scan.FULL_TEXTS["mit-text"]
    rows = [(1, f"{prose(900)}\n{full}\n{prose(900)}\n{full.replace('Software', 'Work', 2)}\n{prose(9)}"), (2, full), (3, f"{prose(70)} released under\nthe MIT License, {prose(50)}\n"), (4, f"{prose(50)} released under the MIT License {prose(50)}"), (5, f"{prose(3000)}\n{license_scan.FULL_TEXTS['apache-2.0-text']}{prose(3000)}")]
    got = {r["doc_id"]: r["matches"] for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    lines = full.count("\n")  # the last one holds no new bigram
    assert [(m["line"], m["last"], m["dice"] == 1) for m in got[1] if m["license"] == "mit-text"] == [(1, lines - 1, True), (lines + 3, 2 * lines + 1, False)]
    assert [(m["license"], m["line"], m["dice"]) for m in got[2] if m["license"] == "mit-text"] == [("mit-text", -1, 1.0)]
    assert [tuple(m) for m in got[3]] == [("mit", 1.0, 0, 1)] and [tuple(m) for m in got[4]] == [("mit", 1.0, 0, 0)]
    assert ("apache-2.0-text", 1.0) in [(m["license"], m["dice"]) for m in got[5]]
    templates = {"a": "w1 w2 w3 w4 w5 w6", "b": "w1 w2 w3", "c": "w3 w1 w2 w2 w1 w5 w4 w6 w1"}
    rows = [(i, "".join(f"w{rng.randint(1, 7)}{rng.choice('   \n')}" for _ in range(rng.randint(0, 40)))) for i in range(150)]
    rows += [(200 + i, f"w9 w8 {v[:9]} {v[9:]} w7 w9\nw8") for i, v in enumerate(templates.values())]
    got = {r["doc_id"]: r["matches"] for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), templates).collect()}
    for (i, t), (k, v) in itertools.product(rows, templates.items()):
        w, of = license_scan.words(t), set(license_scan.bigrams(v))
        runs = [set(itertools.pairwise(w[a:b])) for a, b in itertools.combinations(range(len(w) + 1), 2)]
        best = max((2 * len(of & {" ".join(p) for p in u}) / (len(of) + len(u)) for u in runs), default=0)
        dice = [m["dice"] for m in got[i] if m["license"] == k]
        assert bool(dice) == (best >= 0.8) and (not dice or max(dice) <= best + 1e-12)


def near_brute(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        c = len(sets[a] & sets[b])
        if c and 100 * c >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    shared = [rng.choice(words) for _ in range(60)]
    rows = []
    for k in range(70):
        base = [rng.choice(words) for _ in range(rng.choice([3, 6, 8, 9, 12, 30, 80, 200]))]
        if k % 3 == 0:
            base = shared + base[: rng.randint(0, 40)]
        for _ in range(rng.randint(1, 5)):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(text) // 30))):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((len(rows), " ".join(text)))
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, "One two"), (len(rows) + 3, "one TWO")]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == near_brute(rows)


def test_every_link_has_a_signature():
    """Without Spark: each pair that links shares a probed signature, whatever shingles are frequent."""
    rng = np.random.default_rng(5)
    for size, share in itertools.product((1, 2, 3, 4, 5, 7, 12, 40, 150), (0.0, 0.5, 0.8, 0.95, 1.0)):
        for _ in range(12):
            hot = np.unique(rng.integers(0, 2**64, max(1, int(size * share)), dtype=np.uint64))
            own = rng.integers(0, 2**64, size - int(size * share), dtype=np.uint64)
            a = np.unique(np.concatenate([hot[: int(size * share)], own]))
            n = len(a)
            cut = rng.integers(0, max(1, n // 4) + 1)
            more = rng.integers(0, 2**64, rng.integers(0, max(1, n // 4) + 1), dtype=np.uint64)
            b = np.unique(np.concatenate([rng.permutation(a)[cut:], more]))
            c = len(np.intersect1d(a, b))
            if not c or 100 * c < 75 * (len(a) + len(b) - c):
                continue
            frequent = hot if share else np.zeros(0, np.uint64)
            (x, fx, rx), (y, fy, ry) = (ngram_join.all_signatures(s, frequent) for s in (a, b))
            reach = rx + ry + abs(len(a) - rx - len(b) + ry) <= ngram_join.differ(len(a) + len(b))
            left = {}
            for s, f in zip(x.tolist(), fx.tolist()):
                left.setdefault(s, []).append(f)
            assert any((f | g) & 3 == 3 and (reach or not (f | g) & 4) for s, g in zip(y.tolist(), fy.tolist()) for f in left.get(s, ()))


def test_decontamination(spark):
    rng = random.Random(11)
    words = [f"t{i}" for i in range(40)]
    bench = [(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate((3, 10, 14, 30, 30))] + [(9, ""), (10, None)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(50))) for i in range(20)]
    docs += [(30 + i, f"x {t.upper() if t else ''}, y {t}") for i, (_, t) in enumerate(bench)] + [(90, None), (91, "")]
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    wins = {}
    for i, t in bench:
        w = find(t)
        k = min(10, len(w))
        for j in range(len(w) - k + 1 if w else 0):
            wins.setdefault(tuple(w[j : j + k]), set()).add(str(i))
    for block in (1 << 20, 100):  # one block of the benchmark, and several
        got = decontam.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"), block_bytes=block)
        got = {r["doc_id"]: r for r in got.withColumn("n_hit", decontam.n_hit()).collect()}
        for i, t in docs:
            w, hit, items = find(t), set(), set()
            for k in {len(x) for x in wins}:
                for j in range(len(w) - k + 1):
                    if tuple(w[j : j + k]) in wins:
                        hit |= set(range(j, j + k))
                        items |= wins[tuple(w[j : j + k])]
            assert (got[i]["n_words"], got[i]["n_hit"], got[i]["items"]) == (len(w), len(hit), sorted(items))
    clean = decontam.remove_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench[:0], "item_id long, text string"))
    assert clean.count() == len(docs) and clean.columns == ["doc_id", "text"]


def test_differencing_and_shards(spark):
    rng = random.Random(2)
    sizes = [rng.randint(1, 10_000) for _ in range(3000)]
    sums = np.bincount(sharding.split_sizes(sizes, 16), sizes, 16)
    assert sums.sum() == sum(sizes) and sums.max() - sums.min() <= 16
    assert sorted(np.bincount(sharding.split_sizes([8, 7, 6, 5, 4], 2), [8, 7, 6, 5, 4])) == [14, 16]
    rows = [(i, "t" * (i % 97) if i % 50 else None, None) for i in range(2000)]
    got = sharding.shard(frame(spark, rows), 4, bucket_groups=20).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    texts = {i: t or "" for i, t, _ in rows}
    assert len({(texts[r["doc_id"]], r["shard"]) for r in got}) == len(set(texts.values()))


def test_fingerprints(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    rows = [(i * 3, " ".join(rng.choice(words) for _ in range(rng.randint(0, 150))), None) for i in range(60)] + [(200, None, None), (201, "", None)]
    rows.append((300, rows[0][1], None))
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(frame(spark, rows), chunk_rows=7).collect()}
    texts = [t or "" for _, t, _ in rows]
    for k, (i, _, _) in enumerate(rows):
        n, nxt = len(texts[k]), texts[(k + 1) % len(rows)]
        edited = texts[k][: n - n // 4] + nxt[: n // 4]
        assert got[i]["n_chars"] == n and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    assert got[0]["fingerprint"] == got[300]["fingerprint"] and got[200]["near_next"] == 1.0
    assert fingerprint.fingerprints(frame(spark, [])).count() == 0


def test_html():
    page = """<html><head><title>T</title></head><body><nav><a href=x>Home</a></nav><div class="ad">Buy this now</div>
    <article><h1>Head &amp; line</h1><p>The cat   is on<br>the mat.<p>Short one.<div class="comments"><p>I do not like it at all, it is bad.</p></div></article>
    <aside>More of the same for you</aside><footer>&copy; 2020</footer><script>var t = "</p>";</script></body></html>"""
    assert html_extract.extract(page) == "Head & line\n\nThe cat is on the mat.\n\nShort one."
    assert html_extract.extract(None) == html_extract.extract("") == ""
    for broken in ("<", "<p", "<a href='", "<!--", "</", "a < b", "<script>", "<p hidden>x", "&#x110000;&#0;"):
        assert isinstance(html_extract.extract(broken), str)


def test_html_blocks_decide_on_either_side_of_an_article():
    story = "".join(f"<p>It was the {w} of the year and they had all been there with us for a long time.</p>" for w in ("end", "best", "start"))
    links = "<p><a href=x>More of this here</a></p>" * 3
    text = re.sub(r"</p>", "\n\n", story).replace("<p>", "").strip()
    assert html_extract.extract(f"<body><nav>Home</nav><h1>Head</h1>{story}<article><a href=x>Card</a></article><footer>End</footer>") == f"Head\n\n{text}"
    for name in ("article", "main", "div"):
        got = html_extract.extract(f"<body><nav>Home</nav><{name}><h1>Head</h1>{story}{links}<p>Short one.</p>{links}</{name}><footer>End</footer>")
        assert got == f"Head\n\n{text}", name


def test_html_keeps_captions_formulas_and_signs():
    long = "This is the story of the sign © and of all that was done with it by us in the year that had been."
    page = f"<body><article><p>{long}</p><figure><img src=x><figcaption>The caption</figcaption></figure><p>{long} <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math></p><p>© 2020 Us</p></article>"
    assert html_extract.extract(page) == f"{long}\n\nThe caption\n\n{long} x=1"
    for name in ("svg", "video", "canvas", "object", "noscript", "iframe"):
        assert html_extract.extract(f"<body><p>{long}</p><{name}><p>{long}</p>") == f"{long}\n\n{long}", name
        assert html_extract.extract(f"<body><p>{long}</p><{name}>fallback</{name}><p>{long}</p>") == f"{long}\n\n{long}", name
    assert html_extract.extract(f"<body><p>{long}</p><script><p>{long}</p>") == long


def test_classifiers():
    rng = random.Random(1)
    good = [" ".join(rng.choice(["the", "cat", "sat", "home"]) for _ in range(40)) for _ in range(60)]
    bad = [" ".join(rng.choice(["$$$", "###", "XX!!"]) for _ in range(40)) for _ in range(60)]
    model = quality.fit(good[:40] + bad[:40], [1] * 40 + [0] * 40)
    p = quality.score_texts(model, good[40:] + bad[40:] + [""])
    assert p[:20].min() > 0.5 > p[20:40].max() and p[40] == 0.5
    assert quality.score_texts(quality.fit([], []), ["", "a"]).shape == (2,)
    de = [" ".join(rng.choice(["der", "und", "nicht", "straße", "über"]) for _ in range(80)) for _ in range(20)]
    crf = langid.fit(good[:20] + de, ["en"] * 20 + ["de"] * 20)
    assert langid.predict_texts(crf, [good[50], de[0], "", "123"])[0] == ["en", "de", "und", "und"]
    m, _ = langid.label_words(crf, [" ".join(good[50].split()[:12] + de[0].split()[:12])])
    assert Counter(m.argmax(1)[:12])[1] >= 11 and Counter(m.argmax(1)[12:])[0] >= 11
    assert np.allclose(m.sum(1), 1, atol=1e-4)


def test_all_languages_are_learned(spark):
    rows = [(100 * k + i, " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{c}" for c in "aeiou"), f"l{k:02}") for k in range(70) for i in range(8)]
    crf = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert crf.labels == [f"l{k:02}" for k in range(70)]


def test_forward_backward_sums_all_paths():
    rng = np.random.default_rng(0)
    scores, trans = rng.normal(size=(4, 1, 3)), rng.normal(size=(3, 3))
    m, pairs = langid.forward_backward(scores, trans, np.array([4]))
    weight = {path: np.exp(sum(scores[t, 0, s] for t, s in enumerate(path)) + sum(trans[a, b] for a, b in itertools.pairwise(path))) for path in itertools.product(range(3), repeat=4)}
    z = sum(weight.values())
    want = np.array([[sum(w for p, w in weight.items() if p[t] == s) / z for s in range(3)] for t in range(4)])
    assert np.allclose(m[:, 0], want) and pairs.sum() == pytest.approx(3)


def test_words_are_null_safe():
    raw, offsets = utf8(pa.array(["ab", None, "", "c"]))
    assert bytes(raw) == b"abc" and offsets.tolist() == [0, 2, 2, 2, 3]
