"""Parts of the text operators against brute force: suffix search, whole chains, passes, levels of sharding, likeness."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from isoloom.llm import decontam, fingerprint, html_extract, langid, sharding
from isoloom.llm.common import utf8


def brute_leaks(texts, items, window):
    """Hit words, items found and longest match of each text, comparing all places with all places."""
    out = []
    for text in texts:
        w, hit, found, longest = text.split(), set(), set(), 0
        for name, item in items:
            v = item.split()
            for i, j in itertools.product(range(len(w)), range(len(v))):
                n = 0
                while i + n < len(w) and j + n < len(v) and w[i + n] == v[j + n]:
                    n += 1
                if n and n >= min(window, len(v)):
                    hit |= set(range(i, i + n))
                    found.add(name)
                    longest = max(longest, n)
        out.append((len(hit), sorted(found), longest))
    return out


@pytest.mark.parametrize("window", [1, 3, 4, 7, 10])
def test_suffix_search(window):
    rng = random.Random(window)
    few = [f"w{i}" for i in range(4)]
    texts = [" ".join(rng.choice(few) for _ in range(rng.randrange(0, 40))) for _ in range(25)] + ["w1 " * 60, "", "zz w1 w2 zz"]
    items = [(f"i{k}", " ".join(rng.choice(few) for _ in range(rng.randrange(1, 25)))) for k in range(12)] + [("same", "w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1")]
    count, spans, found, longest = decontam.search(*utf8(pa.array(texts)), decontam.items_of(items, window))
    got = [(sum(e - b for b, e in zip(s[::2], s[1::2])), f, int(n)) for s, f, n in zip(spans, found, longest)]
    assert got == brute_leaks(texts, items, window)
    assert count.tolist() == [len(t.split()) for t in texts]


def test_suffix_search_of_one_word_repeated():
    """Places times tests would be 800 million pairs; only those that begin a match are listed."""
    text, item = "again " * 40_000, "again " * 20_000
    _, spans, found, longest = decontam.search(*utf8(pa.array([text])), decontam.items_of([("x", item)], 10))
    assert spans == [[0, 40_000]] and found == [["x"]] and longest.tolist() == [20_000]


def test_benchmark_in_blocks_equals_whole(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(60))) for i in range(40)], "doc_id long, text string")
    items = [(f"i{k}", " ".join(rng.choice(words) for _ in range(3))) for k in range(200)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    want = {tuple(map(str, r)) for r in decontam.find_leaks(docs, bench).collect()}
    assert {tuple(map(str, r)) for r in decontam.find_leaks(docs, bench, block_bytes=700).collect()} == want


def test_marginals_are_of_the_whole_chain():
    rng = np.random.default_rng(1)
    for n in (1, 31, 32, 33, 64, 65, 200):
        k = 3
        scores, trans = rng.normal(size=(n, 1, k)) * 2, rng.normal(size=(k, k)) * 2
        want, _ = langid.forward_backward(scores, trans, np.array([n]))
        first, count = np.array([0, 0]), np.array([n, 0])
        places, length, row = langid._sequences(first, count)
        pieces = np.bincount(row, minlength=2)
        product = langid.products(scores[:, 0][places], trans, length)
        begin, end = langid.messages(product, trans, np.cumsum(pieces) - pieces, pieces)
        got, _ = langid.forward_backward(scores[:, 0][places], trans, length, begin, end)
        live = np.arange(langid.SPAN)[:, None] < length
        flat = np.zeros((n, k))
        flat[places[live]] = got[live]
        assert np.allclose(flat, want[:, 0])


def test_long_text_is_one_chain():
    """Words that say nothing take the language of words more than a piece away."""
    de = ["der und nicht ein haus " * 12] * 20
    en = ["the and not a house of " * 12] * 20
    crf = langid.fit(de + en, ["de"] * 20 + ["en"] * 20)
    marginal, _ = langid.label_words(crf, ["der und nicht ein haus " * 10 + "qqq " * 70, "the and not a house of " * 10 + "qqq " * 70])
    assert marginal[50:120, 0].mean() > marginal[180:250, 0].mean()


def brute_second_pass(found):
    """Labels by the definition: distance to every decided block, `BORDER` for a border and for a boilerplate element."""
    decided = [(i, b) for i, b in enumerate(found) if b.label]
    if not any(b.label == "good" for _, b in decided):
        return [b.label or "good" for b in found]
    outside = any(b.main and b.label == "good" for b in found)
    out = []
    for i, b in enumerate(found):
        far = {k: min((abs(i - j) + html_extract.BORDER * ((c.main != b.main) + c.bad) for j, c in decided if c.label == k), default=10**6) for k in ("good", "bad")}
        out.append(b.label or ("good" if far["good"] < far["bad"] or far["good"] == far["bad"] and (b.main or not outside) else "bad"))
    return out


def test_second_pass_is_nearest_neighbours():
    rng = random.Random(9)
    for _ in range(400):
        found = [html_extract.Block(bad=rng.random() < 0.3, main=rng.random() < 0.5, text="x", label=rng.choice(["", "", "good", "bad"])) for _ in range(rng.randrange(1, 40))]
        for b in found:
            if b.bad:
                b.label = "bad"
        want = brute_second_pass(found)
        html_extract.second_pass(found)
        assert [b.label for b in found] == want


def test_inheritance_decides_blocks_of_real_pages(spark):
    undecided = settled = 0
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect():
        for html in (r["html"], r["html"].replace("<article", "<div").replace("</article", "</div")):
            found = html_extract.parse(html)
            html_extract.first_pass(found)
            open_ = [b for b in found if not b.label]
            undecided += len(open_)
            html_extract.second_pass(found)
            settled += sum(b.label == "good" for b in open_)
            assert all(b.label for b in found)
    assert settled > 100


def test_short_blocks_follow_their_neighbours():
    links = "".join(f"<div><a href=x>Link number {i} of a list</a></div>" for i in range(3))
    page = f"<body>{links}<div>Read on here</div>{links}<p>{LONG}</p><p>A short end.</p><p>{LONG}</p>{links}<div>Last words</div></body>"
    assert html_extract.extract(page) == f"{LONG}\n\nA short end.\n\n{LONG}"


LONG = "It was said that all of them had been there for a long time, and that none of it was as they would have it in the end."


@pytest.mark.parametrize("name", ["notice-of-social-reform", "social-policy", "post-header", "entry-title", "adventure"])
def test_names_that_only_hold_a_boilerplate_word(name):
    assert html_extract.extract(f"<body><div class='{name}'><p>{LONG}</p></div></body>") == LONG


@pytest.mark.parametrize("name", ["sidebar", "comments-list", "socialLinks", "cookie-policy", "site-header", "ad", "AdBox", "related posts"])
def test_names_of_boilerplate(name):
    assert html_extract.extract(f"<body><div class='{name}'><p>{LONG} No.</p></div><p>{LONG}</p></body>") == LONG


def test_stray_tags_take_linear_time():
    html = "<div>" * 20_000 + "</p>" * 20_000 + "<svg>" * 3000 + f"<p>{LONG}</p>"
    assert html_extract.extract(html) == LONG


def test_buckets_combined_in_levels(spark):
    rows = [(i, "x" * (i * 37 % 211)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = sharding.shard(docs, 4, bucket_groups=10)
    two = sharding.shard(docs, 4, bucket_groups=10, max_buckets=3)
    for got in (one, two):
        sizes = {}
        for r in got.collect():
            sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
        assert len(sizes) == 4 and max(sizes.values()) - min(sizes.values()) <= 2 * 211
    assert two.count() == 3000



def test_differencing_is_near_the_best_split():
    rng = random.Random(5)
    for _ in range(30):
        sizes = [rng.randrange(1, 30) for _ in range(8)]
        best = min(max(sum(s for s, p in zip(sizes, parts) if p == j) for j in range(2)) for parts in itertools.product(range(2), repeat=8))
        parts = sharding.split_sizes(sizes, 2)
        assert max(sum(s for s, p in zip(sizes, parts) if p == j) for j in range(2)) <= best + 5


def xx(value, seed=42):
    return xxhash.xxh64(value, seed=seed).intdigest()


def signed(h):
    return h - (1 << 64) if h >= 1 << 63 else h


def brute_fingerprint(text, lexicon):
    """I-Match with levels by plain Python: the hashes are those of 64-bit xxHash with seed 42, folded over arrays."""
    words = {w for w in "".join(c if c.isalnum() else " " for c in text.lower()).split()}
    terms = sorted(signed(xx(w.encode())) for w in words if w in lexicon)
    level = max(0, int(np.ceil(np.log2(max(len(terms), 1) / (1.5 * fingerprint.SUBSETS)))))
    parts = []
    for l in (level, level + 1):
        kept = [t for t in terms if ((t & (1 << 64) - 1) >> 8) & ((1 << l) - 1) == 0]
        hashes = []
        for r in range(fingerprint.SUBSETS):
            h = 42
            own = [t for t in kept if t & (fingerprint.SUBSETS - 1) == r]
            for t in own:
                h = xx(int(t).to_bytes(8, "little", signed=True), h)
            hashes.append(f"{h:X}" if own else "0")
        parts.append(f"{l}:{'.'.join(hashes)}")
    return ";".join(parts) if terms else None


def brute_likeness(a, b):
    if a == b:
        return 1.0
    of = lambda f: {} if f.startswith("x") else dict(p.split(":") for p in f.split(";"))
    x, y = of(a), of(b)
    for l in sorted(set(x) & set(y), key=int):
        pairs = [(p, q) for p, q in zip(x[l].split("."), y[l].split(".")) if (p, q) != ("0", "0")]
        return sum(p == q for p, q in pairs) / len(pairs) if pairs else 0.0
    return 0.0


def test_fingerprints_equal_brute_force(spark):
    rng = random.Random(6)
    words = [f"t{i}" for i in range(200)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 90)))) for i in range(80)] + [(200, ""), (201, "Zz zz")]
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), chunk_rows=9).collect()}
    n = len(rows)
    df = {}
    for _, t in rows:
        for w in set(t.lower().split()):
            df[w] = df.get(w, 0) + 1
    low, high = max(fingerprint.LEAST_DOCS, fingerprint.LEAST_SHARE * n), max(fingerprint.LEAST_DOCS, fingerprint.MOST_SHARE * n)
    lexicon = {w for w, k in df.items() if low <= k <= high}
    prints = {}
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % n][1]
        edited = t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]
        for column, text in (("fingerprint", t), ("edited_fingerprint", edited)):
            want = brute_fingerprint(text, lexicon)
            assert got[i][column] == want if want else got[i][column].startswith("x:"), (i, column)
        prints[i] = got[i]["fingerprint"]
    for k, (i, _) in enumerate(rows):
        assert got[i]["near_edited"] == pytest.approx(brute_likeness(got[i]["fingerprint"], got[i]["edited_fingerprint"]))
        assert got[i]["near_next"] == pytest.approx(brute_likeness(prints[i], prints[rows[(k + 1) % n][0]]))
