import base64
import bz2
import collections
import gzip
import hashlib
import re
import urllib.parse
import zlib

import pytest
from pyspark.sql import functions as F

from textward.llm.common import join_keys, materialise
from textward.llm import decontaminate, graph, html, linedup, near, pieces, quality, rollup, secrets, sharding, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLDED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Columns of documents, and further ones whose names the operators use too.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, size int, key string, uid string, _uid string, _text string, _doc string, doc string, runs string, n_lines string, n_removed int, id string, slot string, part string, _part int, row int, mark int"


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").orderBy("doc_id").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and very long texts, repeated rows and ids, clashing names."""
    long_ = " ".join(f"w{k % 977} x{k}" for k in range(60_000))
    more = ("en", "s", 1, "a", 1, "k", "u", "x", "x", "x", "x", "x", "x", 1, "x", "x", "x", 1, 1, 1)
    return spark.createDataFrame([(1, None, *more), (2, "", *more), (None, "one two", *more), (3, long_, *more), (4, "same text here now ok", *more), (4, "same text here now ok", *more), (5, " \n\t ", *[None] * 20)], DOCS)


def table(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_every_operator_takes_odd_rows_and_empty_tables(spark, odd):
    none = odd.limit(0)
    bench = spark.createDataFrame([(1, "one two"), (2, None)], "item_id long, text string")
    model = toxicity.fit_texts(["you idiot idiot"] * 3 + [f"x{k} idiot" for k in range(9)], [f"fine {k}" for k in range(20)], 0.3)
    makes = [
        lambda d: sharding.shard_documents(d), lambda d: decontaminate.report(d, bench), lambda d: decontaminate.clean(d, bench), lambda d: toxicity.score_documents(d, model), lambda d: toxicity.reject(d, model),
        lambda d: near.classes(d), lambda d: linedup.delete(d), lambda d: secrets.scan_documents(d), lambda d: pieces.encode_documents(d), lambda d: quality.report(d), lambda d: rollup.count_tokens(d),
    ]
    for make in makes:
        assert make(none).count() == 0
        assert make(odd).count() in (6, 7)
    assert near.deduplicate(odd).count() == 6
    import corpus_pipeline

    for rows_, left in ((none, 0), (odd, 6)):
        now = rows_
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, SF)
            if name != "sentencepiece":
                assert out.columns == odd.columns and out.dtypes == odd.dtypes, name
            now = materialise(out)
        assert now.count() == left
    assert rollup.corpus_history(none).totals().count() == 0
    assert decontaminate.report(odd, bench.limit(0)).where("contaminated").count() == 0
    got = {r["doc_id"]: r for r in decontaminate.report(odd, bench).collect()}
    assert got[None]["contaminated"] and got[None]["n_hit"] == 2 and not got[1]["contaminated"]


def test_sharding(spark, docs, rows):
    got = sharding.shard_documents(docs).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 24)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(24))
    text = dict(rows)
    assert all(r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode()) and r["size"] == len(text[r["doc_id"]].encode()) + 8 for r in got)
    # a heavier rack takes rows only from outside it; inside untouched regions nothing moves
    tree = sharding.even_tree()
    first = tree.children[0]
    heavy = sharding.Node("root", children=(sharding.Node(first.label, first.mass * 2, first.children), *tree.children[1:]))
    ids = spark.range(3000).withColumnRenamed("id", "doc_id")
    pairs = sharding.assign(sharding.assign(ids, tree, shard="a"), heavy, shard="b").where("a <> b").collect()
    assert pairs and all(r["b"] < 8 <= r["a"] for r in pairs)


@pytest.mark.parametrize("name", ["op1_sharding", "op3_decontamination", "op5_near_dedup", "op9_quality_rules"])
def test_queries_against_sql(spark, name):
    import duckdb

    from textward.llm import oracles, queries

    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF), db.sql(oracles.SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda x: sorted(map(str, x))
    assert rows(map(tuple, got.select(cols).collect())) == rows(want.select(*cols).fetchall())


def test_toxicity_on_held_out_labels(spark, docs):
    import zlib

    from textward.llm import queries

    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [(r["held_out"], r["score"], r["predicted"], labels[r["doc_id"]], r["doc_id"]) for r in queries.op4_toxicity(spark, sf).collect() if r["doc_id"] in labels]
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= s <= 1 and p == (s >= 0.7) for h, s, p, _, i in rows)
    held = [(s, p, y) for h, s, p, y, _ in rows if h]
    bad, good = [s for s, _, y in held if y], [s for s, _, y in held if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in bad for b in good) / (len(bad) * len(good))
    hit = sum(p for _, p, y in held if y)
    assert auc > 0.9 and hit > 0.7 * len(bad) and hit > 0.85 * sum(p for _, p, _ in held)
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), fit_bytes=2000)
    assert 0 <= model.score("x")[0] <= 1


def test_html():
    page = (
        '<html><head><title>t</title><style>p{}</style></head><body><div id="top" class="site-header"><h2>head</h2></div><nav><a href="/">menu</a></nav><div class="post-12"><h1>Title &amp; more</h1>'
        '<p>First\n  line<br>goes&nbsp;on, here. <b>bold<p>Second, para with some text.<form><p>form</p></form><ul><li>one<li>two</ul><div class="comments"><p>reader</p></div></div>'
        '<div class="cookie-notice">c</div><aside>side</aside><footer>f</footer><script>var x="</p>";</script></body></html>'
    )
    blocks = html.parse(page)
    path, _, _ = html.best(blocks)
    assert path.endswith("div.post-0")
    assert html.extract(blocks, path) == "Title & more\nFirst line goes on, here. bold\nSecond, para with some text.\none\ntwo"
    assert html.extract(html.parse(None), None) == "" and html.extract(html.parse("<nav>x</nav>"), None) == ""
    assert html.extract(html.parse("plain <p>text"), None) == "plain\ntext"


def test_html_keeps_what_stands_beside_the_inner_container(spark):
    lead, tail, many = "<p>" + "Lead words, here. " * 10 + "</p>", "<section><p>And a last word, with thanks.</p></section>", "<p>" + "Some more text, of it. " * 7 + "</p>"
    page = '<body><div class="post">{}<div class="text">' + many * 12 + "</div>{}</div></body>"
    for a, b in ((lead, ""), ("", tail), (lead, tail), ("<p>By <a>\n        One Author      </a></p>", "")):
        got = html.extract_pages(spark.createDataFrame([(k, "http://h.example/", page.format(a, b)) for k in range(3)], "page_id long, url string, html string"))
        for r in got.collect():
            assert r["text"].startswith(("Lead words", "By One")) == bool(a) and r["text"].endswith("with thanks.") == bool(b)
    assert html.best(html.parse(page.format("<p><a>one</a> | <a>two</a></p>", "")))[0].endswith("div.post>div.text")
    assert html.extract(html.parse("<body><div><a>only a link</a></div></body>"), None) == "only a link"


def test_html_scripts_with_unpaired_quotes():
    for script in ("<script>for(i=0;i<n;i++){} // don't</script>", '<style>/* <b " */</style>', "<script>if(a<b){s='\"'}</script>", "<script>x='<!--'</script>"):
        page = f"{script}<nav>menu</nav><article><p>One.</p>{script}<p>It's \"here\".</p><p>And it isn't.</p></article><footer>foot</footer>"
        path, _, _ = html.best(html.parse(page))
        assert path.endswith("article") and html.extract(html.parse(page), path) == "One.\nIt's \"here\".\nAnd it isn't."


def test_html_odd_markup():
    ex = lambda p: html.extract(html.parse(p), None)
    assert ex("<p>a</p> <3 lots of love") == "a\n<3 lots of love" and ex("<p>a < b and c <d") == "a < b and c"
    assert ex("<p data-x=it's>hello there, one.</p><p>x</p>") == "hello there, one.\nx" and ex('<p title="abc>text</p><p>y') == "text\ny"
    assert ex("<p>a\u2003b&emsp;c\u3000d&nbsp;e</p>") == "a b c d e" and ex('<p title="a > b" x=\'>\'>t</p>') == "t"
    inside = '<article><p>One, two.</p><div class="share-price">12 dollars</div><div class="related-work">Related</div>{}</article>'
    gone = '<div class="share-buttons">S</div><div class="comments">C</div><div id="ad-slot-3">ad</div><div class="related-posts">R</div><div class="post-comments">PC</div>'
    assert ex(inside.format(gone)) == "One, two.\n12 dollars\nRelated"
    import time

    began = time.time()
    for q in "\"'":
        for page in (f"<p a={q}x>" * 8000, "<a " * 8000, f"<a b={q}" * 8001 + ">", "<p a=\"x'>" * 8000, "<" * 20_000 + "x"):
            html.parse(page)
    assert time.time() - began < 10


def test_html_takes_odd_tables(spark):
    kind = "page_id long, url string, html string, host string, path string, text string"
    rows = [(1, "http://h/a", "<p>x, y.</p>", "q", "q", "q"), (1, "http://h/a", "<p>x, y.</p>", "q", "q", "q"), (None, None, None, None, None, None), (2, "", "", "", "", ""), (3, "http://h/b", "<p>" + "word, " * 200_000, *[None] * 3)]
    df = spark.createDataFrame(rows, kind)
    assert html.extract_pages(df.limit(0)).count() == 0
    got = sorted((r["page_id"] or 0, r["n_chars"]) for r in html.extract_pages(df).collect())
    assert got == [(0, 0), (1, 5), (1, 5), (2, 0), (3, 1_199_999)]


def test_html_consensus(spark):
    good = '<body><div class="main"><p>A long sentence, with words. And one more, here.</p></div><div class="box"><p>{}</p></div></body>'
    rows = [(k, "http://h.example/a", good.format("x")) for k in range(6)] + [(9, "http://h.example/b", good.format("much longer text, here. " * 9)), (10, None, "<p>alone</p>"), (11, "x", None)]
    got = table(html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")), "page_id")
    assert got[9]["text"].startswith("A long sentence") and "much" not in got[9]["text"]
    assert got[10]["text"] == "alone" and got[11]["text"] == "" and got[11]["n_chars"] == 0
    many = table(html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), hosts_broadcast=0), "page_id")
    assert {k: v["text"] for k, v in many.items()} == {k: v["text"] for k, v in got.items()}


def brute_contamination(texts, items, window=10):
    out = []
    for t in texts:
        w, hit, names = FOLDED.findall(low(t or "")), set(), set()
        for i, s in items:
            s = FOLDED.findall(low(s or ""))
            m = min(window, len(s))
            for j in range(len(s) - m + 1 if m else 0):
                for p in range(len(w) - m + 1):
                    if w[p : p + m] == s[j : j + m]:
                        hit |= set(range(p, p + m))
                        names.add(i)
        out.append((len(w), len(hit), names))
    return out


def test_decontamination_against_brute_force():
    import random

    for seed in range(80):
        r = random.Random(seed)
        voc = ["a", "B", "cé", "d1", "É", "漢", "x"][: r.randint(2, 7)]
        make = lambda n, r=r, voc=voc: r.choice([" ", "-", "\n", ", "]).join(r.choice(voc) for _ in range(n))
        items = [(str(i), make(r.choice([0, 1, 2, 3, 5, 12, 14, 20]))) for i in range(r.randint(0, 5))]
        texts = [make(r.randint(0, 60)) + " " + (r.choice(items)[1] if items and r.random() < 0.6 else "") for _ in range(6)]
        hits, names, matches = decontaminate.search_shard([decontaminate.words(t) for t in texts], decontaminate.Block(items), longest=True)
        assert [(len(decontaminate.words(t)), len(h), n) for t, h, n in zip(texts, hits, names, strict=True)] == brute_contamination(texts, items)
        for d, item, p, q, n in matches:
            w, s = decontaminate.words(texts[d]), decontaminate.words(dict(items)[item])
            assert w[p : p + n] == s[q : q + n] and (p + n == len(w) or q + n == len(s) or w[p + n] != s[q + n])


def test_decontamination_longest_match(spark):
    import random

    r = random.Random(8)
    texts = [" ".join(r.choice("abcd") for _ in range(r.randint(0, 40))) for _ in range(60)] + ["a " * 9_000]
    items = [(str(k), " ".join(r.choice("abcd") for _ in range(r.randint(1, 14)))) for k in range(12)] + [("x", "a " * 12)]
    for block_bytes in (1 << 20, 60):
        got = table(decontaminate.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"), window=6, block_bytes=block_bytes))
        for k, t in enumerate(texts):
            w, best = t.split()[:100], (0, None, -1, -1)
            for i, s in items:
                s = s.split()
                for q in range(len(s) - min(6, len(s)) + 1):
                    for p in range(len(w)):
                        n = next((n for n in range(len(s) - q) if p + n >= len(w) or w[p + n] != s[q + n]), len(s) - q)
                        if n >= min(6, len(s)):
                            best = min(best, (-n, i, p, q))
            x = got[k]
            assert (-x["longest_words"], x["longest_item"], x["longest_at"], x["longest_item_at"]) == best and x["contaminated"] == (best[0] < 0)


def test_decontamination_of_a_long_item(spark):
    import random
    import tracemalloc

    r = random.Random(2)
    item = [f"w{r.randrange(50_000)}" for _ in range(20_000)]
    tracemalloc.start()
    block = decontaminate.Block([("long", " ".join(item)), ("short", "one two")])
    hits, items, matches = decontaminate.search_shard([[w.encode() for w in item[500:19_000]], [b"one", b"two"]], block, longest=True, best=True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [len(h) for h in hits] == [18_500, 2] and items == [{"long"}, {"short"}]
    assert min((-n, i, p, q) for _, i, p, q, n in matches) == (-18_500, "long", 0, 500) and peak < 200 << 20
    twice = decontaminate.search_shard([[b"one", b"two", b"six"]], decontaminate.Block([("x", "one two"), ("x", "six")]))
    assert [len(h) for h in twice[0]] == [3] and twice[1] == [{"x"}]


def test_decontamination_blocks(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    one, many = table(decontaminate.report(docs, bench)), table(decontaminate.report(docs, bench, block_bytes=1500))
    assert one == many
    assert decontaminate.clean(docs, bench).count() == sum(not r["contaminated"] for r in one.values())


def test_toxicity_learns_and_is_fuzzy(spark):
    import random

    r = random.Random(1)
    filler = lambda: " ".join("".join(r.choice("aeioulnrst") for _ in range(6)) for _ in range(30))
    bad = ["worthless", "disgusting", "scumbag"]
    toxic = [f"{filler()} {r.choice(bad)} {filler()} {r.choice(bad)}" for _ in range(120)]
    clean = [filler() + " " + filler() for _ in range(240)]
    model = toxicity.fit_texts(toxic[:80], clean[:160], 0.33)
    assert {t for t, whole in model.terms if whole} >= set(bad)
    assert all(model.score(t)[0] >= 0.7 for t in toxic[80:]) and all(model.score(t)[0] < 0.7 for t in clean[160:])
    assert model.score("so worthles and disqusting")[1] == 2 and model.score("")[0] < 0.5
    plain, quoted = model.score("a scumbag b worthless")[0], model.score('he said "scumbag" and "worthless" again')[0]
    assert quoted < plain
    assert toxicity.fit_texts([], clean, 0.0).score("x")[0] < 1e-6


def test_automaton_against_edit_distance():
    import random

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row

    terms = [("idiot", True), ("moron", True), ("worthless", True), ("achlich", False), ("scum", True)]
    auto = toxicity.Automaton(terms)
    r = random.Random(3)
    for _ in range(3000):
        t = list(r.choice(terms)[0])
        for _ in range(r.randint(0, 3)):
            k = r.randrange(len(t) + 1)
            t[k : k + r.randint(0, 1)] = r.choice(["", "a", "i", "s", "o"])
        w = "".join(t) + r.choice(["", "", "er", "x"])
        want = {}
        for n, (term, whole) in enumerate(terms):
            d = distance(term, w)
            best = d[-1] if whole else min(d)
            if best <= toxicity.allowed(term, whole):
                want[n] = best
        assert dict(auto(w)) == want, w


def brute_classes(rows, percent):
    sets = {}
    for i, t in rows:
        w = WORD.findall(low(t or ""))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_against_brute_force(spark, docs, rows):
    for percent in (80, 85):
        got = table(near.classes(docs, percent))
        assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == brute_classes(rows, percent)
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.values())


def test_near_duplicates_in_a_large_family(spark):
    import random

    r = random.Random(5)
    base = [f"w{k}" for k in range(120)]
    made = [(0, " ".join(base))]
    for i in range(1, 90):
        t = base[:]
        for _ in range(r.randint(0, 4)):
            t[r.randrange(len(t))] = f"n{r.random()}"
        made.append((i, " ".join(t)))
    old, near.BLOCK = near.BLOCK, 16
    try:
        got = table(near.classes(spark.createDataFrame(made, "doc_id long, text string")))
    finally:
        near.BLOCK = old
    assert {i: (x["n_shingles"], x["component_id"]) for i, x in got.items()} == brute_classes(made, 85)


def test_pigeonhole_guarantee():
    import numpy as np

    r = np.random.default_rng(2)
    a = r.integers(0, 2**32, near.SYMBOLS, dtype=np.uint32)
    for _ in range(300):
        b = a.copy()
        b[r.choice(near.SYMBOLS, near.DISTANCE, replace=False)] ^= np.uint32(1)
        k = near.keys(np.stack([a, b]))
        assert (k[0] == k[1]).any()


def test_distance_follows_the_threshold():
    import numpy as np

    assert (near.DISTANCE, near.CHUNKS) == (near.distance_of(85), near.chunks_of(near.distance_of(85))) == (17, 9)
    r = np.random.default_rng(4)
    for percent in (50, 80, 85, 100):
        d = near.distance_of(percent)
        assert near.miss(percent, d) <= near.MISS and (d == 0 or near.miss(percent, d - 1) > near.MISS)
        for _ in range(200):
            pair = np.tile(r.integers(0, 1 << 32, near.SYMBOLS, dtype=np.uint32), (2, 1))
            pair[1, r.permutation(near.SYMBOLS)[:d]] ^= 1
            a, b = near.keys(pair, near.chunks_of(d))
            assert (a == b).any() and (d == 0 or near._forest(pair, d) == [(0, 1)])


def test_rows_that_share_a_doc_id(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(1, a), (1, b), (1, b), (2, a + " end"), (3, b + " end"), (4, c), (4, c), (5, "z " + c), (4, ""), (None, a), (None, a)]
    left = sorted(near.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=str)
    assert left == sorted([(1, a), (1, b), (4, c), (4, ""), (None, a), (None, a)], key=str)


def test_hot_keys_are_joined_whole(spark):
    rows = spark.createDataFrame([(k % 7 if k % 3 else 100, k) for k in range(3000)], "k long, v long")
    per_key = materialise(rows.groupBy("k").agg(F.max("v").alias("m"), F.count("*").alias("n")))
    got = sorted(map(tuple, join_keys(rows, per_key, ["k"]).select("k", "v", "m").collect()))
    assert got == sorted(map(tuple, rows.join(per_key, "k").select("k", "v", "m").collect())) and len(got) == 3000


def test_components(spark):
    edges = [(k + 1, k) for k in range(40)] + [(100, 90), (95, 100), (7, 7)]
    got = {r["id"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {90: 90, 95: 90, 100: 90}
    for hub in (0, 5000, 2500):  # a hub of nearly all edges, whatever its place in the order
        edges = [(hub, k) for k in range(1, 3000)] + [(9000, 9001), (9001, 9002)]
        got = {r["id"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {k: min(hub, 1) for k in {*range(1, 3000), hub}} | {9000: 9000, 9001: 9000, 9002: 9000}


def brute_lines(rows, least):
    blank = " \t\n\x0b\x0c\r"
    seqs = []
    for i, t in rows:
        ls = (t or "").split("\n")
        has = [k for k, x in enumerate(ls) if x.strip(blank)]
        seqs.append((i, ls, has, [ls[k].strip(blank) for k in has], [len(WORD.findall(ls[k])) for k in has]))
    runs, first = [], {}
    for n, (_, _, _, s, w) in enumerate(seqs):  # every run, not only the shortest ones
        for a in range(len(s)):
            for e in range(a + 1, len(s) + 1):
                if sum(w[a:e]) >= least:
                    key = tuple(s[a:e])
                    runs.append((n, a, e, key))
                    first[key] = min(first.get(key, (n, a)), (n, a))
    gone = collections.defaultdict(set)
    for n, a, e, key in runs:
        if first[key] != (n, a):
            gone[n] |= set(range(a, e))
    out = {}
    for n, (i, ls, has, _, _) in enumerate(seqs):
        g = {has[k] for k in gone[n]}
        out[i] = (len(has), len(g), "" if g and len(g) == len(has) else "\n".join(x for k, x in enumerate(ls) if k not in g))
    return out


def test_line_dedup_against_brute_force(spark):
    import random

    for seed in range(3):
        r = random.Random(seed)
        voc = [" ".join(f"v{k}" for _ in range(r.randint(1, 5))) for k in range(6)] + ["", "  "]
        made = [(i, "\n".join(r.choice(voc) for _ in range(r.randint(0, 14)))) for i in range(25)]
        made += [(100 + k, made[k][1]) for k in range(5)]
        got = table(linedup.delete(spark.createDataFrame(made, "doc_id long, text string"), min_words=7))
        assert {i: (x["n_lines"], x["n_removed"], x["text"]) for i, x in got.items()} == brute_lines(made, 7)


def test_secrets_base_and_layers():
    s = 'token = "abcdefghijklmnop"'
    packed = base64.b64encode(zlib.compress((s * 3).encode())).decode()
    text = "see " + urllib.parse.quote("x=" + base64.b64encode(s.encode()).decode() + "&y=" + packed) + " and " + chr(92) + "u0074oken: abcdefghijklmnop"
    shown, all_, layers = secrets.scan(text)
    assert set(shown) <= set(all_) and layers >= 4
    assert sum(k == 0 for _, k, _ in all_) >= 3
    begin, _, end = next(x for x in all_ if text[x[0]] == chr(92))
    assert text[begin:end].startswith(chr(92)) and text[begin:end].endswith("oken: abcdefghijklmnop")
    assert secrets.scan("")[:2] == ([], []) and secrets.scan("%25" * 40)[2] < 60
    assert [x[1] for x in secrets.base("token=password = abcdefghijklmnop")] == []
    assert secrets.spelled(secrets.base("AKIA" + "B" * 14 + " 0123456789abcdef")) == "access:0:18,hex:19:35"


@pytest.mark.parametrize("pack", [zlib.compress, gzip.compress, bz2.compress])
def test_secrets_whole_streams(pack):
    s = b' token = "abcdefghijklmnop"'
    for data in (pack(b"ab " * (3 << 20) + s), pack(b"one") + pack(s)):
        text = "x " + base64.b64encode(data).decode().rstrip("=")
        assert secrets.scan(text)[1] == [(2, 0, len(text))]


def test_secrets_layers_with_odd_bytes():
    s = 'token = "abcdefghijklmnop"'
    for odd in ("\xa0", "\ufeff", "\u200b", "\u3000", "\f", "\0"):
        assert secrets.scan(base64.b64encode((odd + s).encode()).decode())[1], odd
    assert secrets.scan(base64.b64encode(b"caf\xe9 " + s.encode()).decode())[1]
    text = "漢 ?q=caf%E9&token%3Dabcdef123456789"
    assert [text[b:e] for b, _, e in secrets.scan(text)[1]] == ["token%3Dabcdef123456789"]
    for pack in (zlib.compress, gzip.compress, bz2.compress):
        data = pack(s.encode())
        spelled = ["".join(f"%{b:02X}" for b in data), urllib.parse.quote(data), "".join(f"\\x{b:02x}" for b in data), repr(data)[2:-1], "".join(f"\\u00{b:02x}" for b in data), base64.b64encode(gzip.compress(data)).decode()]
        for one in spelled:
            text = f"see v={one} end"
            assert any(k == 0 and one.startswith(text[b:b + 8]) and text[e:] in (" end", "= end", "== end") for b, k, e in secrets.scan(text)[1]), (pack, one)


def test_secrets_glued_and_wrapped_base64():
    s = 'token = "abcdefghijklmnop"'
    code = base64.b64encode(s.encode()).decode()
    for glued in ("https://h.example.com/", "/", "x_", "x-y_", "ab", "abc", "abcd"):
        text = glued + code + "/more"
        ((b, k, e),) = secrets.scan(text)[1]
        assert (b, k) == (len(glued), 0) and text[b:e] == code[: e - b] and e - b >= len(s) * 4 // 3 - 2
    plain = "".join(f"line {k}, {hashlib.md5(str(k).encode()).hexdigest()[:9]}. " for k in range(9))
    for width in (64, 76):
        for sep in ("\n", "\r\n", "\n  ", "\\n"):
            for cut in range(34, 80, 5):
                data = (plain[:cut] + s + plain).encode()
                wrapped = lambda x: sep.join(re.findall(f".{{1,{width}}}", base64.b64encode(x).decode()))
                text = "see:" + sep + wrapped(data)
                assert any(k == 0 and e - b - len(sep) * text.count(sep, b, e) >= len(s) * 4 // 3 - 3 for b, k, e in secrets.scan(text)[1])
                for pack in (zlib.compress, gzip.compress, bz2.compress):
                    text = "see " + wrapped(pack(data))
                    assert [(b, k) for b, k, _ in secrets.scan(text)[1]] == [(4, 0)] and len(text) - secrets.scan(text)[1][0][2] <= 2


def test_secrets_base_against_plain_patterns(rows):
    kinds = [("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), lambda m: len(m[2]) >= 12), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16)]
    for _, t in rows:
        want = sorted((m.start(), k, m.end()) for k, (_, rx, ok) in enumerate(kinds) for m in rx.finditer(t) if ok(m))
        assert secrets.base(t) == want


def test_sentencepiece_is_the_librarys(spark, rows):
    import random

    import sentencepiece

    m, lib = pieces.compiled(pieces.model_path()), sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    texts = [t for _, t in rows]
    for s in range(800):
        r = random.Random(s)
        texts.append("".join(r.choice(["a", "th", " ", "  ", "\n", "\t", "é", "漢", "​", "ing", "The", "1", "!", "▁", "😀", "eee", " " * 17, "\0", "w" * 120]) for _ in range(r.randint(0, 30))))
    texts += [" " * n + tail for n in (1, 14, 15, 16, 17, 31, 65, 200, 1000) for tail in ("", "x", "漢")]
    for t in texts:
        ids = m.encode(t)
        assert ids == lib.encode(t), t
        assert "▁" in t or m.decode(ids) == t
    import pyarrow as pa

    coder = pieces._Batch(m)
    for k in range(0, len(texts), 150):
        part = texts[k : k + 150]
        data, at = coder.normalised(pa.array(part, pa.string()))
        ids, count = coder.encode(data, at)
        ends = count.cumsum()
        assert [ids[e - c : e].tolist() for e, c in zip(ends, count, strict=True)] == lib.encode(part)
        assert coder.same(data, at, ids, count).all()
        wrong = ids.copy()
        wrong[::7] += 1
        assert not coder.same(data, at, wrong, count).all()
    some = spark.createDataFrame(rows[:50], "doc_id long, text string")
    coded = pieces.encode_documents(some)
    assert coded.where("NOT round_trip").count() == 0
    assert {r["doc_id"]: r["text"] for r in pieces.decode_documents(coded).collect()} == dict(rows[:50])


def test_neighbours_against_merging():
    import random

    import numpy as np

    m, r = pieces.compiled(pieces.model_path()), random.Random(1)
    ids = [i for i in m.known.tolist() if len(m.text[i]) < 9]
    left, right = np.array(r.choices(ids, k=4000)), np.array(r.choices(ids, k=4000))
    want = [m.merge(m.text[a] + m.text[b]) != (m.text[a], m.text[b]) for a, b in zip(left.tolist(), right.tolist(), strict=True)]
    assert m.apart(left, right).tolist() == want and 50 < sum(want) < 3950
    same = np.array([i for i in ids if len(set(m.text[i])) == 1])
    for a in same.tolist():
        want = [m.merge(m.text[a] + m.text[b]) != (m.text[a], m.text[b]) for b in same.tolist()]
        assert m.apart(np.full(len(same), a), same).tolist() == want


def test_unigram_model_is_the_librarys(tmp_path):
    import random
    import struct

    import sentencepiece

    def field(n, value):
        if isinstance(value, int):
            return bytes([n << 3, value])
        if isinstance(value, float):
            return bytes([n << 3 | 5]) + struct.pack("<f", value)
        return bytes([n << 3 | 2]) + varint(len(value)) + value

    def varint(x):
        return bytes([x & 127 | 128]) + varint(x >> 7) if x > 127 else bytes([x])

    r = random.Random(7)
    pieces_ = [("<unk>", 0.0, 2), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256))]
    plain = sorted({"".join(r.choice("abc▁")[:1] for _ in range(r.randint(1, 4))) for _ in range(60)} | set("abc▁é"))
    pieces_ += [(p, -r.random() * 9 - 0.1, 1) for p in plain if "▁" not in p[1:] or not p.strip("▁")]
    data = b"".join(field(1, field(1, p.encode()) + field(2, float(s)) + field(3, k)) for p, s, k in pieces_)
    data += field(2, field(3, 1) + bytes([35 << 3 & 127 | 128, 35 >> 4, 1])) + field(3, field(1, b"identity") + field(2, b"") + field(3, 1) + field(4, 0) + field(5, 1))
    path = tmp_path / "unigram.model"
    path.write_bytes(data)
    lib, m = sentencepiece.SentencePieceProcessor(model_file=str(path)), pieces.Transducer(str(path))
    assert m.kind == pieces.UNIGRAM
    for _ in range(400):
        t = "".join(r.choice(["a", "b", "c", " ", "é", "漢", "ab", "  "]) for _ in range(r.randint(1, 24)))
        got, want = m.encode(t), lib.encode(t)
        weigh = lambda ids: sum(m.score.get(m.text[i], 0.0) for i in ids)
        assert m.decode(got) == lib.decode(want) == t and abs(weigh(got) - weigh(want)) < 1e-4  # of equal sums either may win


def test_quality_against_brute_force(docs, rows):
    got = table(quality.report(docs))
    for i, t in rows:
        w = WORD.findall(t)
        grams, inside = collections.Counter(zip(w, w[1:], w[2:], strict=False)), set()
        for k, g in enumerate(zip(w, w[1:], w[2:], strict=False)):
            inside |= {k, k + 1, k + 2} if grams[g] > 1 else set()
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside), len(w) < 50 or 100 * len(inside) > 50 * len(w))
        assert tuple(got[i])[1:7] == want
        assert not (got[i]["base_failed"] and got[i]["kept"]) and got[i]["kept"] == (got[i]["failed_rule"] is None)


def test_quality_order_changes_no_verdict(docs):
    every = quality.rules(F.coalesce("text", F.lit("")))
    a = docs.select("doc_id", quality.cascade(every).isNull().alias("k")).collect()
    b = docs.select("doc_id", quality.cascade(every[::-1]).isNull().alias("k")).collect()
    assert sorted(a) == sorted(b)


def test_rollup(spark, docs, rows):
    log = rollup.Rollup(spark)
    one = spark.createDataFrame([("s", None, 5, 10), ("s", None, 5, 10)], "source string, lang string, n_tokens long, n_chars long")
    assert log.commit("a", rollup.image(one, 1, "v")) and not log.commit("a", rollup.image(one, 1, "v"))
    assert [tuple(r) for r in log.totals().collect()] == [("s", "", "v", 2, 10, 20)]
    log.commit("b", rollup.image(one.limit(1), -1, "v"))
    log.commit("none", rollup.image(one.limit(0), 1, "v"))
    assert rollup.Rollup(spark, log.path).totals().collect()[0]["n_docs"] == 1
    log.commit("c", rollup.image(one.limit(1), -1, "v"))
    assert log.totals().count() == 0 and log.committed() == {"a", "b", "none", "c"}
    log.commit("../a/b", rollup.image(one, 1, "v"))
    assert log.committed() >= {"../a/b"} and not log.commit("../a/b", rollup.image(one, 1, "v"))
    got = rollup.corpus_history(docs).totals().collect()
    code, groups = rollup.Counter().code, collections.Counter()
    for r in docs.orderBy(F.desc("doc_id")).collect():  # the first of equal texts, by doc_id, is left
        first = {r["text"]: r} if not groups else first | {r["text"]: r}
        groups["any"] = 1
    want = collections.defaultdict(lambda: [0, 0, 0])
    for t, r in first.items():
        for version, n in (("byte_bpe_50k", len(code.encode_ordinary(t))), ("words", len(FOLDED.findall(low(t))))):
            want[r["source"], r["lang"], version] = [x + y for x, y in zip(want[r["source"], r["lang"], version], (1, n, len(t)), strict=True)]
    assert {(r["source"], r["lang"], r["tokenizer"]): [r["n_docs"], r["n_tokens"], r["n_chars"]] for r in got} == want
    first = {}
    for i, t in rows:
        first.setdefault(t, i)
    assert sum(r["n_docs"] for r in got if r["tokenizer"] == "words") == len(first)
    assert sum(r["n_tokens"] for r in got if r["tokenizer"] == "words") == sum(len(FOLDED.findall(low(t))) for t in first)


def test_pipeline_against_brute_force(spark, docs, rows):
    import corpus_pipeline
    from textward.llm.common import materialise

    bench = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in now.collect()}
        now = materialise(stage(spark, now, SF))
        after = {r["doc_id"]: r for r in now.collect()}
        ordered = sorted(before.items())
        if name == "toxicity":
            model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            assert set(after) == {i for i, t in ordered if model.score(t)[0] < 0.7}
        elif name == "line_dedup":
            want = {i: t for i, (n, gone, t) in brute_short_lines(ordered).items() if not gone or gone < n}
            assert {i: r["text"] for i, r in after.items()} == want
        elif name == "near_dedup":
            assert set(after) == {i for i, (_, c) in brute_classes(ordered, 80).items() if i == c}
        elif name == "decontamination":
            grams = collections.defaultdict(int)
            for _, s in bench:
                w = FOLDED.findall(low(s))
                for j in range(len(w) - 9):
                    grams[tuple(w[j : j + 10])] += 1
            assert set(after) == {i for i, t in ordered if not any(tuple(w[j : j + 10]) in grams for w in [FOLDED.findall(low(t))] for j in range(len(w) - 9))}
        else:
            assert set(after) == set(before) and all(r["round_trip"] for r in after.values())
        if name != "sentencepiece":
            assert now.columns == docs.columns


def brute_short_lines(rows):
    """brute_lines with the shortest runs only; the property that these suffice is tested above."""
    out, least = {}, linedup.MIN_WORDS
    blank = " \t\n\x0b\x0c\r"
    first, runs, seqs = {}, [], []
    for n, (i, t) in enumerate(rows):
        ls = t.split("\n")
        has = [k for k, x in enumerate(ls) if x.strip(blank)]
        s, w = [ls[k].strip(blank) for k in has], [len(WORD.findall(ls[k])) for k in has]
        seqs.append((i, ls, has))
        for a in range(len(s)):
            for step in (1, -1):
                total, e = 0, a
                while 0 <= e < len(s) and total < least:
                    total += w[e]
                    e += step
                if total >= least:
                    lo, hi = (a, e) if step == 1 else (e + 1, a + 1)
                    runs.append((n, lo, hi, tuple(s[lo:hi])))
    for n, a, _, key in runs:
        first[key] = min(first.get(key, (n, a)), (n, a))
    gone = collections.defaultdict(set)
    for n, a, e, key in runs:
        if first[key] != (n, a):
            gone[n] |= set(range(a, e))
    for n, (i, ls, has) in enumerate(seqs):
        g = {has[k] for k in gone[n]}
        out[i] = (len(has), len(g), "\n".join(x for k, x in enumerate(ls) if k not in g))
    return out


def test_digests(docs):
    empty = hashlib.sha256(b"").hexdigest()
    assert secrets.scan_documents(docs.limit(5)).where(F.col("base_sha256") == empty).count() >= 1
