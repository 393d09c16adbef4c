"""URL filters, WARC, HTML extraction, embeddings, sharding, queries, pipeline."""

import collections
import functools
import gzip
import io
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from shapewright.llm import decontaminate, embeddings, html, langid, queries, sharding, simhash, urls, warc
from shapewright.llm.common import new_dir

SF = "/root/testdata/sf0.001"
PAGE = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet(f"{SF}/pages.parquet")


# --- urls ---


def test_rules(spark):
    want = {
        "http://A.example.NET/en/x?q=/": ("allow", "example.net/en/"),
        "http://a.example.net/fr/": ("block", "net/"),
        "http://net/": ("block", "net/"),
        "http://internet/": ("allow", None),
        "http://a.net": ("allow", None),
        "http://x.example.com/de/a#b": ("block", "example.com/de/"),
        "http://x.example.com/de": ("allow", None),
        "https://w.org/fr/1": ("allow", "org/fr/"),
        "no scheme": ("allow", None),
        None: ("allow", None),
        "http://u@a.net:80/": ("allow", None),
        "a://b.net/x://c": ("block", "net/"),
    }
    rows = urls.judge(spark.createDataFrame([(i, u, "", 1) for i, u in enumerate(want)], PAGE + ", host int")).collect()
    assert {list(want)[r.page_id]: (r.verdict, r.rule) for r in rows} == want


def test_trie_is_longest_match():
    rng = np.random.default_rng(0)
    hosts, paths = ["", "a", "b.a", "c.b.a", "c"], ["", "/", "/x", "/x/", "/x/y", "/xy", "/x//"]
    rules = [(("allow", "block")[rng.integers(2)], h, p) for h in hosts for p in paths if rng.random() < 0.4]
    trie = urls.Trie(rules)
    for host in ("a", "z.b.a", "c.b.a", "c", "q.c", "", "ba"):
        for path in ("", "/", "/x", "/x/y/z", "/xyz", "/x//q"):
            fit = [r for r in rules if (not r[1] or host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
            best = max(fit, key=lambda r: (len(r[1].split(".")) if r[1] else 0, len(r[2])), default=None)
            assert trie.find(host, path) == (best and (best[0], best[1] + best[2]))


# --- WARC ---


def archive(n, compressed=True):
    parts = [warc.record("response", i, f"http://h/{i}", (f"payload {i} " * (i + 1)).encode(), warc.digest((f"payload {i} " * (i + 1)).encode())) for i in range(n)]
    return [gzip.compress(p, mtime=0) if compressed else p for p in parts]


@pytest.mark.parametrize("compressed", [True, False])
@pytest.mark.parametrize("step", [7, 1 << 20])
def test_salvage(compressed, step):
    parts = archive(6, compressed)
    read = lambda raw: [(k, a.get("x-page-id") if k == "record" else (a, b)) for k, a, b in warc.salvage(io.BytesIO(raw), compressed, step)]
    assert read(b"".join(parts)) == [("record", str(i)) for i in range(6)]
    assert read(b"") == []
    at = [sum(map(len, parts[:i])) for i in range(7)]
    broken = bytearray(b"".join(parts))
    for k in range(at[2] + len(parts[2]) // 2, at[2] + len(parts[2]) // 2 + 9):
        broken[k] ^= 0x5A
    assert read(bytes(broken)) == [("record", "0"), ("record", "1"), ("gap", (at[2], at[3])), ("record", "3"), ("record", "4"), ("record", "5")]
    junk = b"\x1f\x8b\x08WARC/junk"
    assert read(junk + parts[0] + junk + parts[1]) == [("gap", (0, len(junk))), ("record", "0"), ("gap", (len(junk) + len(parts[0]), 2 * len(junk) + len(parts[0]))), ("record", "1")]
    cut = parts[0] + parts[1][:-9]
    assert read(cut) == [("record", "0"), ("gap", (len(parts[0]), len(cut)))]


def test_round_trip(spark, pages):
    rows = [(1, "u", "x"), (0, "u", "x"), (0, "u", "x"), (2, None, None), (3, "a\r\nb: c", ""), (None, "n", "x"), (5, "ü", "ü\r\n\r\nWARC/1.1\r\n")]
    table = spark.createDataFrame(rows, PAGE).withColumn("sha", F.lit(1)).withColumn("n", F.lit(1))
    got = warc.round_trip(table).collect()
    assert sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in got) == sorted([("0", 1, "response", None)] * 2 + [("1", 1, "revisit", 0), ("2", 0, "response", None), ("3", 0, "revisit", 2), ("None", 1, "revisit", 0), ("5", 16, "response", None)])
    assert warc.round_trip(table.limit(0)).collect() == []
    assert {r.record_type for r in warc.round_trip(table, at_least=2).collect()} == {"response"}
    path = new_dir(spark, "test")
    back = warc.read_archives(warc.write_archives(pages, path, roll=20_000), path)
    assert {r.page_id: bytes(r.block).decode() for r in back.collect()} == {r.page_id: r.html for r in pages.collect()}


def test_archives_are_read_in_parallel(spark, pages):
    """As many tasks as archives, up to the cores at least; all have their share."""
    for parts in (1, 3, 12):
        path = new_dir(spark, "test")
        manifest = warc.write_archives(pages.repartition(parts), path, roll=1 << 30)
        archives = manifest.count()
        back = warc.read_archives(manifest, path)
        held = back.groupBy(F.spark_partition_id().alias("p")).agg(F.countDistinct("archive").alias("n")).collect()
        assert len(held) >= min(archives, spark.sparkContext.defaultParallelism) and max(r.n for r in held) <= 2
        assert back.count() == pages.count()


# --- HTML ---


def test_expressions():
    assert html.spell(html.stream("<ul><li>a</li><li><b>b</b> c</li><li>d</li></ul>")) == "<ul>(<li>#</li>)+</ul>"
    one = html.stream("<div><p>a</p></div><footer>x</footer>")
    two = html.stream("<div><h1>t</h1><p>a</p><p>b</p></div><footer>x</footer>")
    assert html.spell(html.align(one, two)) == "<div>(<h1>#</h1>)?(<p>#</p>)+</div><footer>#</footer>"
    assert html.align(html.align(one, two), one) == html.align(one, two)
    assert html.align(one, one) == one


PAGES = {
    '<html><head><title>t</title></head><body><header>h</header><nav><a>x</a></nav><article><h1>Head</h1><p>One &amp; <b>tw</b>o<br>three<p>Four</article><aside>s</aside><footer>f</footer>': "Head One & two three Four",
    '<body><script>var t="</p><article>x</article>";</script><main><div class="ad">buy</div><p>A&nbsp;&#233;<!-- c --></p><form><p>f</p></form><section class="comments"><article class="comment">c</article></section></main></body>': "A é",
    '<div id="content"><p>x</p></div><div class="sidebar-2">y</div>': "x",
    "<p>bare</p><ul><li>a<li>b</ul>": "bare a b",
    "text < 5 & more": "text < 5 & more",
    '<div class="cookie notice">n</div><p>y</p>': "y",
    "<article></article><p>y</p>": "y",
    "": "",
    None: "",
    "<article><style>p{}</style><p>a</p><svg><text>z</text></svg><noscript>n</noscript>": "a",
}

#: Pages that are read alone: names and words decide.
ALONE = {
    '<article><p>a</p><span class="advert">BUY</span>': "a",
    '<article><div class="article-header"><h1>Head</h1></div><p>a</p>': "Head a",
    '<div class="x"><div class="article-header"><h1>Head</h1></div><p>a</p></div>': "Head a",
    '<article><div class="form-data">f</div><p>a <math><mi>x</mi><mo>+</mo><mn>1</mn></math></p><object>o</object></article>': "f a x+1 o",
    "<datalist><option value=a></datalist><article><p>q</p></article>": "q",
    '<button>x<article><p>q</p>un<span class="hl">bro</span>ken</article>': "q unbroken",
    "<noscript>n<article><p>q</p></article>": "q",
    "<nav><ul><li>x<article><p>q</p></article>": "q",
    "<select><option>a<option>b</select><p>c</p>": "c",
    "<table><tr><td>a<td>b<tr><td>c</table>": "a b c",
    "<article><title>t": "",
    "<p>a<br>b<hr>c<img>d</p></i></p>e": "a b cd e",
    "<div>" * 5000 + "deep" + "</div>" * 5000 + "<p>x": "deep x",
}


def test_main_text(spark):
    rows = [(i, f"http://h{i % 3}/x" if i else None, t) for i, t in enumerate(PAGES)]
    got = html.main_text(spark.createDataFrame(rows, PAGE).withColumn("host", F.lit(1))).collect()
    assert {list(PAGES)[r.page_id]: r.text for r in got} == PAGES and all(r.n_chars == len(r.text) for r in got)
    assert html.main_text(spark.createDataFrame([], PAGE)).collect() == []


def test_pages_alone():
    assert {p: html.extract(p) for p in ALONE} == ALONE


def words(rng, n):
    return " ".join(f"w{k}" for k in rng.integers(0, 5000, n))


def test_the_wrapper_decides(spark):
    """Class names in no list: what is constant over a host's pages, repeated
    links and what lies beside the container with the varying text goes. Without
    inference it stays."""
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for i in range(9):
        head, data, formula, paragraphs = words(rng, 5), words(rng, 6), words(rng, 2), [words(rng, 30) for _ in range(rng.integers(1, 6))]
        says = "".join(f"<div class=msg><b>{words(rng, 1)}</b><p>{words(rng, 8)}</p></div>" for _ in range(rng.integers(0, 5)))
        links = "".join(f"<li><a href={k}>{words(rng, 1)}</a>" for k in range(4))
        rows.append((i, f"http://h.org/{i}", f'''<html><body><div class="zz"><ul class="tabs"><li>Home<li>News<li>Shop</ul></div><ul class="yy">{links}</ul><div class="qq">
            <div class="article-header"><h1>{head}</h1></div><ul class="tabs"><li>One<li>Two</ul><div class="form-data">{data}</div><p>x <math>{formula}</math> y <span class="advert">BUY {words(rng, 2)}</span></p>
            {"".join(f"<p>{p}</p>" for p in paragraphs)}</div><div class="discussion">{says}</div><div class="bottom">All rights and such of us</div></body></html>'''))
        want[i] = " ".join([head, data, f"x {formula} y", *paragraphs])
    table = spark.createDataFrame([*rows, rows[0], (None, *rows[1][1:])], PAGE).withColumn("form", F.lit("x")).withColumn("roles", F.lit("x")).withColumn("h", F.lit("x"))
    got = html.main_text(table).collect()
    assert len(got) == 11 and {r.page_id: r.text for r in got} == want | {None: want[1]}
    plain = {r.page_id: r.text for r in html.main_text(table, infer=False).collect()}
    assert all(plain[i] != want[i] and "Home News Shop" in plain[i] and "BUY" not in plain[i] for i in want)


def test_headline_beside_the_article_and_copies(spark):
    rng = np.random.default_rng(9)
    page = lambda head, text, note="n": f'<body><ul class="m"><li>A<li>B</ul><h1>{head}</h1><div class="tt"><p>{text}</p><p>{text}</p></div><div class="note">{note}</div>'
    rows = [(i, "http://h.org/", page(words(rng, 4), words(rng, 40))) for i in range(6)]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, PAGE)).collect()}
    assert all(got[i].split()[:2] == t.split("<h1>")[1].split()[:2] and "A B" not in got[i] and len(got[i].split()) == 84 for i, _, t in rows)
    # one article under many notes is no furniture
    same = [(i, "http://h.org/", page("head", "the same words " * 9, f"note {i}")) for i in range(6)]
    assert all("the same words" in r.text for r in html.main_text(spark.createDataFrame(same, PAGE)).collect())


def test_pages_match_their_wrapper():
    """No text is lost, whatever the pages; most of it has a slot, and the
    pages of one template have all of it in the same slots."""
    rng = np.random.default_rng(10)

    def element(depth):
        if depth == 0 or rng.random() < 0.3:
            return f"<p>{words(rng, 2)}</p>"
        name = ("div", "section", "ul", 'div class="a"', 'div class="b"')[rng.integers(5)]
        inner = "".join(f"<li>{words(rng, 1)}" for _ in range(rng.integers(1, 4))) if name == "ul" else "".join(element(depth - 1) for _ in range(rng.integers(1, 5)))
        return f"<{name}>{inner}</{name.split()[0]}>"

    pages = ["".join(element(3) for _ in range(rng.integers(1, 6))) for _ in range(60)]
    wrapper = html.Wrapper(functools.reduce(html.align, map(html.stream, pages)))
    held = total = 0
    for page in pages:
        text = re.sub("<[^>]*>", " ", page).split()
        assert sorted(html.extract(page, wrapper, "." * len(wrapper.keys)).split()) == sorted(text)
        held, total = held + sum(len(t.split()) for t, _, _ in html.slot_values(page, wrapper).values()), total + len(text)
    assert held >= 0.8 * total
    pages = [f"<div>{'<p>a</p>' * rng.integers(1, 4)}</div><div>{'<b>b</b>' * rng.integers(0, 2)}x</div>{'<h2>h</h2><p>c</p>' * rng.integers(0, 4)}<div><ul>{'<li>d' * rng.integers(1, 3)}</ul></div>" for _ in range(40)]
    wrapper = html.Wrapper(functools.reduce(html.align, map(html.stream, pages)))
    seen = collections.defaultdict(set)
    for page in pages:
        for i, (text, _, _) in html.slot_values(page, wrapper).items():
            seen[i] |= set(text.replace("bx", "x").split())
    assert all(len(x) == 1 for x in seen.values()) and {x for s in seen.values() for x in s} == set("axhcd")


def test_very_long_pages():
    parts = [f"<h{i % 3 + 1}>t</h{i % 3 + 1}><p class='c{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}'>w {i}</p>" for i in range(20_000)]
    page = "<article>" + "".join(parts) + "</article>"
    assert html.extract(page) == " ".join(f"t w {i}" for i in range(20_000))
    assert len(html.spell(html.stream(page))) < 100_000


def test_articles_of_the_table(spark, pages):
    import html as entities
    import re

    def plain(page):
        inner = re.search(r"<article>(.*?)(</article>|<footer>|$)", page, re.S)[1]
        return " ".join(entities.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)[^>]*>", "\n", inner))).split())

    want = {r.page_id: plain(r.html) for r in pages.collect()}
    assert {r.page_id: r.text for r in html.main_text(pages).collect()} == want


# --- embeddings ---


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 16))
    v = np.concatenate([base, base[:25] + rng.normal(size=(25, 16)) * 0.25, base[:10] * 3.5, base[:5], -base[:3]])
    label = rng.integers(0, 2, 40)
    label = np.concatenate([label, label[:25], label[:10], label[:5], label[:3]])
    rows = [(int(i), [float(x) for x in np.float32(v[i])], int(label[i])) for i in rng.permutation(len(v))]
    bad = [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [1.0] * 15 + [None], 0), (1003, [float("nan")] * 16, 0), (1004, rows[0][1], None), (1005, [], 0), (1006, [1.0, 2.0], 0), (None, rows[0][1], rows[0][2])]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit(1)).withColumn("n", F.lit(1))
    x = np.array([np.float32(v[i]) for i in range(len(v))], dtype=float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.93) & (label[:, None] == label[None, :])
    comp = np.arange(len(v))
    while ((new := np.array([comp[near[i]].min() for i in range(len(v))])) != comp).any():
        comp = new
    for tile in (4, 2048):
        got = {r.vec_id: r for r in embeddings.near_duplicates(table, tile=tile).collect()}
        assert len(got) == len(rows) + len(bad)
        assert all((got[i].n_links, got[i].component_id, got[i].kept) == (near[i].sum() - 1, comp[i], comp[i] == i) for i in range(len(v)))
        assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(1000, 1007))
    assert embeddings.near_duplicates(table.limit(0)).collect() == []


# --- sharding ---


def check_shards(rows, texts, shards=24):
    held = collections.defaultdict(list)
    for r in rows:
        held[r.shard].append(r.slot)
    counts = [len(held[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == len(rows)
    assert all(sorted(x) == list(range(len(x))) for x in held.values())
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))


def test_shards(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = sharding.shard(docs).collect()
    check_shards(rows, texts)
    of = collections.defaultdict(set)
    for r in rows:
        of[texts[r.doc_id]].add(r.shard)
    assert sum(len(x) > 1 for x in of.values()) <= 5


def test_shards_of_a_giant_group(spark):
    texts = {i: "same" if i % 3 == 0 else None if i % 50 == 1 else "" if i % 50 == 2 else f"pair {i // 6}" if i < 2000 else f"own {i}" for i in range(6000)}
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("pid", F.lit(1)).withColumn("rank", F.lit(1)).withColumn("shard", F.lit("x"))
    rows = sharding.shard(table).collect()
    check_shards(rows, texts)
    assert len({r.shard for r in rows if texts[r.doc_id] == "same"}) <= 12
    for few in (table.limit(0), table.limit(5), table.limit(1).unionAll(table.limit(1))):
        check_shards(sharding.shard(few).collect(), texts)


# --- queries and pipeline ---


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    duck = duckdb.connect()
    for t in ("embeddings", "pages", "documents"):
        duck.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.sql(f"select {', '.join(columns)} from ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, want))


def test_registered():
    import __spark_entry__

    assert set(queries.QUERIES) <= set(__spark_entry__.queries()) and set(queries.ORACLES) <= set(__spark_entry__.oracle_sql())
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 11)} | {"pipeline"}


def test_pipeline_by_stage(spark):
    """Each stage against what its decisions say about its own input."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, bench = docs.columns, spark.read.parquet(f"{SF}/benchmark.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    known = stages["language_id"](spark, docs, SF)
    assert known.columns == columns and ids(known) == sorted(r.doc_id for r in langid.identify(docs).collect() if r.accepted)
    single = stages["simhash_near_dedup"](spark, known, SF)
    # the job's rule, by brute force: sets of five-word shingles with a similarity of 0.8 or more are linked
    texts = sorted((r.doc_id, r.text) for r in known.collect())
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else frozenset() for w in (t.lower().split() for _, t in texts)]
    near = np.array([[a == b or len(a & b) >= 0.8 * len(a | b) for b in sets] for a in sets])
    label = np.arange(len(texts))
    while ((new := np.array([label[near[i]].min() for i in range(len(texts))])) != label).any():
        label = new
    assert single.columns == columns and ids(single) == sorted({texts[i][0] for i in label})
    clean = stages["benchmark_decontamination"](spark, single, SF)
    assert clean.columns == columns and ids(clean) == sorted(set(ids(single)) - {r.doc_id for r in decontaminate.matches(single, bench).collect()})
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in packed} == set(ids(clean))
    assert corpus_pipeline.ORACLE_SQL is None
