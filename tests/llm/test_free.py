"""Fingerprints, packing, classifier, page text and search against brute force."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from muster.llm import ann, classifier, html, packing, simhash

LONG = " ".join(f"w{i % 977}" for i in range(30_000))
ROWS = [
    (3, "One two THREE four five"),
    (2, "one TWO three four five"),
    (1, None),
    (4, ""),
    (5, " \n\t"),
    (6, LONG),
    (7, LONG + " tail"),
    (8, "ß É 漢字 😀 z"),
    (8, "ß É 漢字 😀 z"),
    (None, "one two three four five"),
    (9, "two words"),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    for name in ("fp", "u", "v", "node", "root", "piece", "rank", "score", "length", "x.y"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def simple_print(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)] * bool(words)
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def simple_components(prints, radius=3):
    """Smallest reachable of each index."""
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= radius:
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    return [root(i) for i in range(len(prints))]


def test_fingerprints_and_components(docs):
    got = simhash.near_duplicates(docs).collect()
    prints = [simple_print(t) for _, t in ROWS]
    groups = simple_components(prints)
    want = []
    for (i, _), p, g in zip(ROWS, prints, groups):
        ids = [k for (k, _), h in zip(ROWS, groups) if h == g and k is not None]
        want.append((i, f"{p:016x}", min(ids)))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_one_document_of_each_group_stays(docs):
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    got = sorted(r.doc_id for r in kept.collect())
    groups = collections.defaultdict(list)
    for (i, _), g in zip(ROWS, simple_components([simple_print(t) for _, t in ROWS])):
        groups[g].append(i)
    assert got == sorted(min(i for i in g if i is not None) for g in groups.values())


def test_long_texts_in_slices(monkeypatch):
    want = simhash.fingerprint(LONG)
    monkeypatch.setattr(simhash, "SLICE", 1000)
    assert simhash.fingerprint(LONG) == want == simple_print(LONG)


def test_links_of_tiles_keep_every_component(spark):
    """Chains, a large group of near copies and noise; tiles so small that all are cut."""
    rng = random.Random(5)
    prints = {rng.getrandbits(64) for _ in range(300)}
    chain = rng.getrandbits(64)
    for bit in range(40):  # each within reach of the one before only
        chain ^= 0b111 << bit
        prints.add(chain)
    centre = rng.getrandbits(64)
    prints |= {centre ^ 1 << a ^ 1 << b for a in range(20) for b in range(a)}
    prints = sorted(prints)
    signed = [p - (p >= 2**63) * 2**64 for p in prints]
    nodes = spark.createDataFrame([(p,) for p in signed], "fp long")
    edges = simhash.links(nodes, tile=40)
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    got, want = collections.defaultdict(set), collections.defaultdict(set)
    for k, (p, g) in enumerate(zip(signed, simple_components(prints))):
        got[roots.get(p, p)].add(k)
        want[g].add(k)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert edges.count() < 40 * len(prints)


def ids_of(text):
    t = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    return t.encode(text or "", add_special_tokens=False).ids + [1]


def test_pieces_are_the_tokenizers(docs, monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 10)
    got = packing.pack(docs, capacity=100, with_ids=True).collect()
    want = collections.Counter()
    for i, t in ROWS:
        ids = ids_of(t)
        for piece, at in enumerate(range(0, len(ids), 100)):
            own = np.array(ids[at : at + 100], "<u4").tobytes()
            want[i, piece, at, len(own) // 4, zlib.crc32(own), own] += 1
    assert want == collections.Counter(
        (r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in got
    )
    held = collections.defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= 100
    assert packing.pack(docs.limit(0)).count() == 0


def test_whole_sequences(docs):
    packed = packing.pack(docs, capacity=100, with_ids=True)
    for r in packing.sequences(packed).collect():
        assert len(r.ids) == 4 * r.length <= 400


@pytest.mark.parametrize(
    "text",
    ["a|b | ||", "<|endoftext|> X<|ENDOFTEXT|>", "É é H̱ ΑΣ İ", "it's DON'T .,! a.. b.'s", "a\xa0b　c\x1cd\x85e",
     "x### y%%% 12.5 3,000 a1b2.", "", "\x00 ​", "ﬁ ½ 😀👍🏽."],
)
def test_words_are_tokenised_as_texts_are(text):
    words = packing.WordTokens(str(public_tokenizers.path("word_bpe_49k.json")), 3)
    for _ in range(2):
        assert np.frombuffer(words.encode(text), "<u4").tolist() == ids_of(text)[:-1]


def best_fit(lengths, capacity):
    """The same rules, item by item."""
    lengths = sorted(lengths, reverse=True)
    large = [n for n in lengths if 3 * n > capacity]
    bins = []
    while large:
        n = large.pop(0)
        mate = next((k for k, m in enumerate(large) if m + n <= capacity), None)
        bins.append([n] if mate is None else [n, large.pop(mate)])
    for n in lengths:
        if 3 * n <= capacity:
            fits = [b for b in bins if capacity - sum(b) >= n]
            if fits:
                max(fits, key=sum).append(n)
            else:
                bins.append([n])
    return bins


def test_plan_counts_as_item_by_item():
    rng = random.Random(3)
    for _ in range(200):
        capacity = rng.choice([10, 37, 100])
        lengths = [min(capacity, int(rng.expovariate(4 / capacity)) + 1) for _ in range(rng.randrange(60))]
        plan = packing.plan_bins(dict(collections.Counter(lengths)), capacity)
        got = collections.Counter()
        for many, held in plan:
            assert sum(held) <= capacity and many > 0
            assert sum(3 * n > capacity for n in held) <= 2
            for n in held:
                got[n] += many
        assert got == collections.Counter(lengths)
        assert sum(m for m, _ in plan) == len(best_fit(lengths, capacity))


def test_classifier_learns_from_positives_and_the_rest(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 4000")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = classifier.classify(docs, labels)
    rows = got.join(labels, "doc_id").where("held_out").collect()
    good = [r.score for r in rows if r.quality == 1]
    bad = [r.score for r in rows if r.quality == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.97
    assert np.mean([g >= 0.3 for g in good]) > 0.97 and np.mean([b < 0.3 for b in bad]) > 0.9
    for r in got.limit(50).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.predicted == (r.score >= 0.3)


def test_labels_of_held_out_rows_and_negatives_are_not_used(spark):
    docs = spark.createDataFrame(
        [(i, f"some text {i}, and more." if i % 4 else "BAD!! " * (i + 5)) for i in range(200)],
        "doc_id long, text string",
    )
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0]
    labels = [(i, 1 if i % 4 else 0) for i in range(0, 200, 2) if i not in held]
    kind = "doc_id long, quality int"
    one = classifier.train(docs, spark.createDataFrame(labels, kind))
    other = labels + [(i, 1) for i in held]
    two = classifier.train(docs, spark.createDataFrame([x for x in other if x[1] == 1], kind))
    assert np.array_equal(one.weights, two.weights) and one.prior == two.prior


def test_a_repeated_id_is_learnt_from_once(spark, monkeypatch):
    rows = [(i, f"some text {i}, and more." if i % 4 else "BAD!! " * (i + 5)) for i in range(100)]
    labels = spark.createDataFrame([(i, 1) for i in range(1, 100, 4)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(classifier, "fit", lambda p, u: seen.append((len(p), len(u), u.tolist())))
    hot = next(i for i in range(1, 100, 4) if zlib.crc32(str(i).encode()) % 5)
    for more in ([], [(hot, rows[hot][1])] * 300, [(hot, f"other {k}") for k in range(300)]):
        docs = spark.createDataFrame(rows + more, "doc_id long, text string")
        classifier.train(docs.repartition(7), labels)
    assert seen[0] == seen[1] and seen[0][:2] == seen[2][:2]


def test_classifier_edges(spark, docs):
    labels = spark.createDataFrame([(3, 1), (2, 1), (6, 1), (7, 1), (None, 1), (4, None)], "doc_id long, quality int")
    got = classifier.classify(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert not [r for r in got if r.doc_id is None][0].held_out
    nothing = classifier.classify(docs, labels.limit(0)).collect()
    assert {r.score for r in nothing} == {1.0}
    assert classifier.classify(docs.limit(0), labels).count() == 0
    model = classifier.train(docs, labels)
    assert classifier.keep_quality(docs, model).columns == docs.columns
    scores = {(r.doc_id, r.score) for r in got if r.doc_id in (1, 4, 5)}
    assert len({s for _, s in scores}) == 1  # texts without words


def test_prior_of_a_known_mixture():
    rng = np.random.default_rng(1)
    positive = rng.normal(size=(4000, 3)) + [2, 0, 0]
    unlabelled = rng.normal(size=(6000, 3)) + np.where(rng.random((6000, 1)) < 0.7, [2, 0, 0], [-2, 0, 0])
    assert abs(classifier.estimate_prior(positive, unlabelled) - 0.7) < 0.06


def test_minimum_cut_is_minimal():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randint(1, 9)
        costs = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(i, j, rng.uniform(0, 2)) for i in range(n) for j in range(i) if rng.random() < 0.5]

        def energy(labels):
            own = sum(max(-c if k else c, 0) for c, k in zip(costs, labels))
            return own + sum(w for i, j, w in edges if labels[i] != labels[j])

        best = min(map(energy, itertools.product([False, True], repeat=n)))
        assert energy(html.minimum_cut(costs, edges)) == pytest.approx(best)


PAGES = {
    "<html><head><title>no</title><style>p{}</style><script>var t='</p>';</script></head><body>"
    "<nav><a href=/>Home</a></nav><div class='ad'>Buy now, please.</div><article><h1>Title</h1>"
    "<p><b>Open bold.<br><p>a<b>b</b>c&nbsp;d &amp;lt; e</p>Stray<aside>no</aside> text"
    "<div class='comments'><p>Great post, thanks!</p></div><footer>by me</footer></article>"
    "<footer>&copy; x": "Title Open bold. abc d &lt; e Stray text",
    None: "",
    "": "",
    "<!-- x -->": "",
    "plain words only, no markup": "plain words only, no markup",
    "<div id=header>Site</div><div class='cookie-notice'>We use cookies, ok.</div>"
    "<div><h2>T</h2><p>A long paragraph of text, with many words, that goes on. And on.</p><p>Short.</p>"
    "<p>Another long paragraph, with commas, and such things as that.</p></div>"
    "<form><p>Your email, please.</p></form><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul>":
    "T A long paragraph of text, with many words, that goes on. And on. Short. "
    "Another long paragraph, with commas, and such things as that.",
}


def test_page_texts(spark):
    rows = [(i, f"u{i}", h) for i, h in enumerate(PAGES)] + [(None, None, "<article>x</article>" * 2)]
    big = "<article>" + "<p>word, word.</p>" * 20_000 + "</article>"
    rows.append((99, "big", big))
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    for name in ("text", "n_chars", "a.b"):
        table = table.withColumn(name, F.lit("clash"))
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in html.extract(table).collect()}
    for i, want in enumerate(PAGES.values()):
        assert got[i] == (f"u{i}", want, len(want))
    assert got[None] == (None, "x x", 3) and got[99][1] == " ".join(["word, word."] * 20_000)
    assert html.extract(table.limit(0)).count() == 0


PROSE = "A long paragraph of text, with many words, that goes on. And on."


@pytest.mark.parametrize(
    "page",
    [
        "<html><head><title>T</title><article><p>{}</article>",
        "<html><head><title>T<article><p>{}</article>",
        "<head><title>T</title><noscript><article><p>{}</article>",
        "<head><title>T</title><noscript><img></noscript><meta x=y><article><p>{}</article>",
        "<head><script>var a = '<body>code, and code.';</script></head><body><article><p>{}</article>",
        "<article><p>{}</p><template><p>Never, never.</p></template></article><textarea>x</textarea>",
        "<body><noscript>Turn on scripts, please, and come again.</noscript><article><p>{}</article>",
    ],
)
def test_open_heads_and_raw_elements(page):
    assert html.main_text(page.format(PROSE)) == PROSE


@pytest.mark.parametrize(
    "page, want",
    [
        ("<div class='content-sidebar-wrap'><main><p>{0}</main></div>", "{0}"),
        ("<article class='post has-comments'><p>{0}</article>", "{0}"),
        ("<div class='no-sidebar'><p>{0}<p>{0}</div>", "{0} {0}"),
        ("<div class='sidebar'><main><p>{0}</main></div>", "{0}"),
        (
            "<article><p>{0}<section id='related-work'><h2 id='search'>Search</h2><p>{0}</section>"
            "<h2 id=menu-design>Menu</h2><p>{0}</article>",
            "{0} Search {0} Menu {0}",
        ),
        # Long text between text is kept whatever its name is; a short one is not.
        ("<article><p>{0}<div class=notice><p>{1}</div><p>{0}</article>", "{0} {1} {0}"),
        ("<main><p>{0}<div class='ad'>Buy, now.</div><div class=comments><p>{0}</div></main>", "{0}"),
        ("<main><p>{0}</main><div role=navigation><p>{1}</div><div id=page-footer>Me</div>", "{0}"),
    ],
)
def test_names_are_one_cost_of_several(page, want):
    long = " ".join([PROSE] * 20)
    assert html.main_text(page.format(PROSE, long)) == want.format(PROSE, long)


def test_pages_of_the_test_data(spark):
    from html import unescape

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in html.extract(pages).join(pages.select("page_id", "html"), "page_id").collect():
        inside = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        want = unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", inside)))
        assert r.text == " ".join(want.split())


def brute_nearest(rows, query, k):
    vectors = dict(rows)
    out = sorted((float(np.sqrt(((np.array(v) - np.array(vectors[query])) ** 2).sum())), i) for i, v in rows if i != query)
    return [(query, n + 1, i, s) for n, (s, i) in enumerate(out[:k])]


def test_search_finds_everything_within_the_radius():
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 2**12, 500).astype(np.uint64)
    index = ann.Index(codes, ((0, 5), (5, 4), (9, 3)))
    for code in codes[:20]:
        for radius in (0, 2, 5, 12):
            want = np.flatnonzero(np.bitwise_count(codes ^ code) <= radius)
            assert index.within(code, radius, 0).tolist() == want.tolist()
        assert len(index.within(code, 0, 40)) >= 40


def test_search_recall_and_blocks(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in table.collect()]
    got = ann.nearest(table, F.col("vec_id") % 100 == 0, index_block=700, query_block=15).collect()
    by_query = collections.defaultdict(list)
    for r in got:
        by_query[r.query_id].append((r.query_id, r["rank"], r.vec_id, r.score))
    hits = total = 0
    for query, found in by_query.items():
        want = brute_nearest(rows, query, 10)
        assert len(found) == 10
        hits += len({w[2] for w in want} & {f[2] for f in found})
        total += 10
    assert len(by_query) == sum(i % 100 == 0 for i, _ in rows) and hits / total >= 0.9


def test_search_edges(spark):
    rows = [
        (0, [1.0, 0.0]), (100, [0.0, 1.0]), (3, [1.0, 0.0]), (2, [1.0, 0.0]), (4, None), (5, [0.0, 0.0]),
        (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [None, 1.0]), (9, [1.0]), (10, []),
        (None, [1.0, 1.0]), (100, [0.0, 1.0]), (11, [0.5, 0.5]), (11, [0.5, 0.5]),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for name in ("vector", "i", "q", "score", "rank"):
        table = table.withColumn(name, F.lit("clash"))
    got = sorted(map(tuple, ann.nearest(table, F.col("vec_id") % 100 == 0).collect()))
    half = 0.5**0.5
    assert [(q, r, v, pytest.approx(s)) for q, r, v, s in got] == [
        (0, 1, 2, 0.0), (0, 2, 3, 0.0), (0, 3, 11, half), (0, 4, 11, half), (0, 5, 100, 2**0.5), (0, 6, 100, 2**0.5),
        (100, 1, 11, half), (100, 2, 11, half), (100, 3, 0, 2**0.5), (100, 4, 2, 2**0.5), (100, 5, 3, 2**0.5),
    ]
    assert ann.nearest(table.limit(0), F.col("vec_id") % 100 == 0).count() == 0
