"""Queries against their SQL, and operators against brute force where a group is large, a row odd or a name taken."""

import glob
import math
import os
import random
from collections import Counter
from hashlib import md5

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import SCHEMA, WORD, near_brute, odd_rows, words
from test_queries import table

from tidemark.llm import bpe, extract, fingerprint, katz, minhash, mixing, quality, queries, repeats, search, url_filter


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    from tidemark.session import ship

    ship(spark)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).cache()


def sql(tables, text):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name, source in tables.items():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{source}'") if isinstance(source, str) else con.register(name, source)
    found = con.execute(text)
    return found.fetchall(), [d[0] for d in found.description]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    rows, columns = sql({os.path.basename(f)[:-8]: f for f in glob.glob(f"{sf}/*.parquet")}, queries.ORACLES[name])
    order = sorted(df.columns)
    assert sorted(columns) == order
    assert table(df.collect(), df.columns, order) == table(rows, columns, order)


@pytest.mark.parametrize("name", sorted(set(queries.ORACLES) - {"op1_url_filter"}))
def test_matches_sql_on_odd_rows(spark, odd, tmp_path, name):
    """Nulls, empty, very long and repeated texts; two texts under one id."""
    rows = odd.select("doc_id", F.when(F.length("text") > 5000, F.left("text", F.lit(5000))).otherwise(F.col("text")).alias("text"), "lang", "source", "n_chars")
    rows = rows.withColumn("doc_id", F.col("doc_id") * 50)
    rows.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    rows.select("doc_id", (F.col("doc_id") % 3).cast("int").alias("quality"), F.lit(1).alias("toxic")).coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    df = queries.QUERIES[name](spark, str(tmp_path))
    got, order = df.collect(), sorted(df.columns)
    want, columns = sql({t: f"{tmp_path}/{t}.parquet/*.parquet" for t in ("documents", "labels")}, queries.ORACLES[name])
    assert table(got, df.columns, order) == table(want, columns, order)


def test_large_groups_of_copies(spark):
    """One group of near copies around a text, one of exact copies, and one of texts that are alike, but not enough."""
    r = random.Random(9)
    base, copied, form = ([f"{k}{r.randrange(10**6)}" for _ in range(60)] for k in "bcf")
    rows = [" ".join(base)]
    for i in range(5000):
        w = list(base)
        w[r.randrange(60)] = f"n{i}"
        rows.append(" ".join(w))
    rows += [" ".join(copied)] * 5000
    for i in range(1200):
        w = list(form)
        w[10], w[40] = f"x{i}", f"y{i}"
        rows.append(" ".join(w))
    ids = list(range(len(rows)))
    r.shuffle(ids)
    df = spark.createDataFrame(list(zip(ids, rows, strict=True)), "doc_id long, text string").repartition(4)
    got = {x.doc_id: x.component_id for x in minhash.near_duplicates(df).collect()}
    first, second = min(ids[:5001]), min(ids[5001:10001])
    assert all(got[i] == first for i in ids[:5001]) and all(got[i] == second for i in ids[5001:10001])
    assert all(got[i] == i for i in ids[10001:])


@pytest.mark.parametrize("how", ["array", "table"])
def test_url_filter_with_any_columns(spark, monkeypatch, how):
    if how == "table":
        monkeypatch.setattr(url_filter, "BROADCAST_BYTES", 0)
    rules = spark.createDataFrame(queries.RULES, "host string, path string, verdict string")
    listed = spark.createDataFrame([(f"h{i}.org", "/a") for i in range(500)] + [("spam.org", "")], "host string, path string")
    one = "http://sub.spam.org/z"
    urls = [one] * 300 + [None] * 300 + [f"https://h{i}.org/a/b" for i in range(40)] + [f"https://g{i}.org/a/b" for i in range(40)] + [f"https://h{i}.org/c" for i in range(40)]
    cols = ["page_id", "url", "best", "_hit_url", "host", "path", "rule", "verdict", "row", "key", "possible", "block", "words", "url_"]
    df = spark.createDataFrame([(i, u, *["x"] * 12) for i, u in enumerate(urls)], ", ".join(f"{c} string" if c != "page_id" else "page_id long" for c in cols))
    out = url_filter.filter_urls(df, rules, listed)
    assert set(out.columns) == set(cols)
    got = {x.page_id: x for x in out.collect()}
    for i, u in enumerate(urls):
        blocked = u is not None and ("spam.org" in u or u.startswith("https://h") and "/a" in u)
        assert got[i].verdict == ("block" if blocked else "allow") and got[i].best == "x" and got[i].url == u, u
    none = url_filter.filter_urls(df, rules.limit(0), listed.limit(0))
    assert none.where("verdict = 'allow' and rule is null").count() == len(urls)


def test_url_filter_with_a_long_list(spark):
    """400,000 entries in 500 shapes (label counts by path lengths), in time that follows their number."""
    import time

    hosts = lambda i: ("", "x.", "x.y.", "x.y.z.", "a.b.c.d.")[i % 5] + f"h{i}.org"
    n = 400_000
    pre = F.element_at(F.array(*map(F.lit, ("", "x.", "x.y.", "x.y.z.", "a.b.c.d."))), (F.col("id") % 5 + 1).cast("int"))
    listed = spark.range(n).select(F.concat(pre, F.lit("h"), F.col("id").cast("string"), F.lit(".org")).alias("host"), F.concat(F.lit("/"), F.repeat(F.lit("a"), (F.col("id") % 100).cast("int"))).alias("path"))
    rules = spark.createDataFrame([("org", "/aaaa", "allow")], "host string, path string, verdict string")
    r = random.Random(12)
    picked = [(r.randrange(2 * n), r.randrange(101), r.random() < 0.5) for _ in range(3000)]
    urls = [(k, f"http://{'sub.' if sub else ''}{hosts(i)}/{'a' * more}") for k, (i, more, sub) in enumerate(picked)]
    start = time.time()
    got = {x.page_id: (x.rule, x.verdict) for x in url_filter.filter_urls(spark.createDataFrame(urls, "page_id long, url string"), rules, listed).collect()}
    assert time.time() - start < 60
    for k, (i, more, _) in enumerate(picked):
        block = i < n and more >= i % 100
        assert got[k] == (("org/aaaa", "allow") if more >= 4 else (None, "block" if block else "allow")), urls[k]


def test_repeated_rows_are_split_at_the_threshold(spark):
    r = random.Random(3)
    rows = [(7, "one same text of six words", "a")] * 3000 + [(i, " ".join(["w"] * r.randrange(1, 30)), "b" if i % 3 else "a") for i in range(100, 400)] + [(None, None, None), (8, "null source", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    taken, target = Counter(), {}
    for x in got:
        taken[x.target] += x.taken
        target[x.target] = x.target
    assert all(abs(taken[t] - t) <= 30 for t in target)
    kept = mixing.mixed(df.withColumn("copies", F.lit("own"))).groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD))).alias("n"))
    assert sorted(x.n for x in kept.collect() if x.n) == sorted(n for n in taken.values() if n)


def prints(text):
    """Winnowing by definition: the set of (position, hash)."""
    w = WORD.findall(text)
    h = [int(md5(x.encode()).hexdigest()[:8], 16) for x in w]
    k, n = fingerprint.K, fingerprint.W

    def poly(xs):
        s = 0
        for x in xs:
            s = (s * fingerprint.BASE + x) % fingerprint.MOD
        return s

    g = [poly(h[i : i + k]) for i in range(len(h) - k + 1)] if len(h) >= k else [poly(h)] if h else []
    out = []
    for i in range(max(len(g) - n + 1, min(len(g), 1))):
        window = g[i : i + n]
        at = max(j for j, x in enumerate(window) if x == min(window))
        if (i + at, g[i + at]) not in out:
            out.append((i + at, g[i + at]))
    return out


def test_fingerprints_by_definition(spark, odd):
    rows = [x.text for x in odd.select(F.left(F.coalesce("text", F.lit("")), F.lit(20000)).alias("text")).collect()] + ["a a a a a a a a a a a a a a", "b " * 40 + "c"]
    df = spark.createDataFrame([(t,) for t in rows], "text string")
    for x in fingerprint.fingerprint(df).collect():
        assert x.fingerprint == " ".join(f"{p:x}:{h:x}" for p, h in prints(x.text)), x.text[:50]


def test_search_reads_less_than_all_and_finds_all(spark):
    r = np.random.default_rng(5)
    topic = lambda i: [f"t{i % 200}x{x}" for x in r.integers(0, 30, 20)]
    texts = [" ".join([*topic(i), *(f"w{x}" for x in r.integers(0, 60, 60))]) for i in range(4000)]
    texts[100:110] = [texts[50]] * 10
    import pyarrow as pa

    from tidemark.llm.words import raw
    from tidemark.llm.words import words as cut

    column = pa.array(texts)
    shard, order = search.Shard.build(*raw(column))
    n, mean = len(texts), shard.size.mean()
    shard.weigh(shard.held.astype(float), n, mean)
    ids = order.astype(np.int64)
    every = 0
    for q in range(0, n, 40):
        terms = np.searchsorted(shard.terms, np.unique(cut(column.slice(q, 1)).hash))
        found, scores = shard.best(terms, 10, ids)
        full = shard.sure(terms)
        want = sorted(zip((-full).round(9).tolist(), ids.tolist(), strict=True))[:10]
        assert [(round(-s, 9), int(i)) for s, i in zip(scores.tolist(), ids[found], strict=True)] == [(s, i) for s, i in want if s < 0]
        every += int((shard.row[terms] >= 0).sum()) * n
    assert shard.read < 0.5 * every


def test_counts_beyond_32_bits():
    x = np.array([0, 1, 5_000_000_000, (1 << 40) + 3])
    assert (katz.unpack_counts(katz.pack_counts(x)) == x).all() and not len(katz.unpack_counts(katz.pack_counts(x[:0])))
    assert katz.added(np.array([0, 1, 0]), np.array([4_000_000_000, 2, 4_000_000_000]), 2).tolist() == [8_000_000_000, 2]


def test_quality_keeps_columns_whatever_their_names(spark, odd):
    df = odd.withColumns({"score": F.lit("s"), "predicted": F.lit("p"), "_k0": F.lit(1), "_text": F.lit("t"), "found": F.lit(2)})
    labels = df.select("doc_id", (F.col("doc_id") % 2).alias("quality"))
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns
    model = quality.fit(df, labels)
    by_rule = [x for x in df.collect() if model.score(quality.features(x.text or "")) >= quality.THRESHOLD]
    assert sorted(map(str, kept.collect())) == sorted(map(str, by_rule))


def test_ratios_and_descent_by_definition(spark):
    """Class counts from all labelled rows, and weights that no step of a single dual variable improves."""
    r = random.Random(8)
    rows = [(i, " ".join(r.choice(["good", "fine", "text"] if i % 2 else ["bad", "junk", "text"]) for _ in range(6)), i % 2) for i in range(200)]
    found = [quality.features(t) for _, t, _ in rows]
    signs = np.array([2.0 * y - 1 for *_, y in rows])
    ratio = np.zeros((1 << quality.BITS) + quality.RUN_FEATURES)
    seen = np.ones((2, len(ratio)))
    for x, s in zip(found, signs, strict=True):
        seen[int(s > 0), x] += 1
    ratio = np.log(seen[1] / seen[1].sum()) - np.log(seen[0] / seen[0].sum())
    w, b = quality.dual_descent(found, signs, ratio, epochs=200)
    margins = np.array([w[x].sum() + b for x in found])
    assert ((margins * signs) > 0.9).all()
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.fit(df.select("doc_id", "text"), df.select("doc_id", "quality"))
    got = [model.score(x) for x in found]
    assert all((s > 0.5) == (y == 1) for s, (*_, y) in zip(got, rows, strict=True))


#: Pages written by hand, apart from `layouts`: html and the text of the article.
P1, P2 = "Il pleuvait depuis le matin, et personne ne sortait de la maison sans raison.", "The committee met again on Monday; it did not agree on anything, as before."
PAGES = [
    (f"<html><body><h1>Un titre</h1><p>{P1}</p><p>{P2}</p></body></html>", f"Un titre {P1} {P2}"),
    (f'<body><div class="c-12"><h1>News</h1><p>{P1}</p><p>{P2}</p></div><div class="c-4"><ul><li><a href="/1">One</a></li><li><a href="/2">Two</a></li><li><a href="/3">Three</a></li></ul></div></body>', f"News {P1} {P2}"),
    (f'<body><table><tr><td><a href="/">Home</a> <a href="/b">About</a></td><td><p>{P1}</p><p>{P2}</p></td></tr></table></body>', f"{P1} {P2}"),
    (f'<body><nav><a href="/">Start</a></nav><div class="texte"><h2>Teil eins</h2><p>{P1}<p>{P2}</div><footer>Alle Rechte</footer></body>', f"Teil eins {P1} {P2}"),
    (f'<body><header><a href="/">Logo</a></header><main><article><h1>A</h1><p>{P1}</p><aside><a href="/x">More</a></aside><p>{P2}</p></article><section id="comments"><p>First!</p></section></main></body>', f"A {P1} {P2}"),
    (f'<body><div class="x><h1>Broken</h1><p>{P1}</p><p>{P2}</p></div></body>', f"Broken {P1} {P2}"),
    (f'<body><div id="cookie-banner"><p>We use cookies on this site.</p></div><div id="content"><p>{P1}</p><form><label>Mail</label><button>Send</button></form><p>{P2}</p></div></body>', f"{P1} {P2}"),
    ("<body><nav><ul><li><a href='/'>Home</a></li><li><a href='/a'>A</a></li></ul></nav><footer>2020</footer></body>", ""),
    (f"{P1}\n{P2}", f"{P1} {P2}"),
    (f"{P1} <b>{P2}</b> &amp; more", f"{P1} {P2} & more"),
    (f"<h1>Titre</h1>{P1}<p>{P2}</p>", f"Titre {P1} {P2}"),
    (f"<nav><a href='/'>Home</a> <a href='/b'>About</a></nav>{P1} {P2}<footer>2020</footer>", f"{P1} {P2}"),
]


def assignments(parent):
    """All assignments of outside (0), article (1) and dropped (2) to the nodes of a tree that decoding allows."""
    found = [[0]]
    for i in range(1, len(parent)):
        found = [[*x, s] for x in found for s in ((0, 1), (1, 2), (2,))[x[parent[i]]]]
    return found


def test_decoding_of_small_trees_by_brute_force():
    r = random.Random(3)
    for _ in range(200):
        n = r.randrange(1, 9)
        parent = [-1] + [r.randrange(i) for i in range(1, n)]
        odds = np.array([r.uniform(-4, 4) for _ in range(n)])

        def worth(x):
            begins = sum(1 for i in range(1, n) if x[i] == 1 and x[parent[i]] == 0)
            return sum(o if s == 1 else -o for o, s in zip(odds, x, strict=True)) - begins

        best = max(assignments(parent), key=worth)
        got = extract.decode(parent, odds)
        assert got.tolist() == [s == 1 for s in best], (parent, odds)


def test_extraction_of_pages_written_by_hand(spark):
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(PAGES)], "page_id long, html string")
    got = {x.page_id: x.text for x in extract.extract(df).collect()}
    assert [got[i] for i in range(len(PAGES))] == [t for _, t in PAGES]


def test_extraction_of_families_not_trained_on():
    for family, least in (("main", 0.9), ("table", 0.85), ("coded", 0.7)):
        model = extract.fit(extract.layouts(300, families=tuple(f for f in extract.FAMILIES if f != family)))
        precision, recall = extract.measured(model, extract.layouts(60, seed=11, families=(family,)))
        assert precision > 0.85 and recall > least, family


def test_parsing_hostile_pages_is_linear():
    import time

    from tidemark.llm.dom import Tree

    took = []
    for n in (20_000, 80_000):
        start = time.process_time()
        for unit in ("<div><span><b>", "</p></i>", '<p "a', "<li><td>"):
            Tree(unit * n)
        Tree("<div>" * n + "</p></b></div>" * n)
        took.append(time.process_time() - start)
    assert took[1] < 10 * took[0] + 0.5


def test_pipeline_stages_by_brute_force(spark, odd, sf):
    """Each stage's rows on a small table with odd rows."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    few = docs.limit(60).unionByName(odd.select(*docs.columns).withColumn("doc_id", F.col("doc_id") + 10**6)).unionByName(docs.limit(5)).cache()
    stage = dict(p.STAGES)
    rows = few.collect()

    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(few, labels)
    good = stage["quality_filter"](spark, few, sf)
    assert sorted(map(str, good.collect())) == sorted(str(x) for x in rows if model.score(quality.features(x.text or "")) >= quality.THRESHOLD)

    one = stage["near_dedup"](spark, few, sf)
    assert one.columns == few.columns
    kept = Counter(x.doc_id for x in one.collect() if words(x.text))
    groups = {None if c < 0 else c for _, n, c in near_brute([(x.doc_id, x.text) for x in rows]) if n}
    assert kept == Counter(groups) and sum(1 for x in one.collect() if not words(x.text)) == sum(1 for x in rows if not words(x.text))

    without = stage["repeat_dedup"](spark, few, sf)
    body = [(x.text or "").encode() for x in rows]
    count = Counter(b[i : i + 200] for b in body for i in range(len(b) - 199))
    want = []
    for b in body:
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if count[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        want.append(bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore"))
    assert sorted(x.text for x in without.collect()) == sorted(want)

    mix = stage["source_mixing"](spark, few, sf)
    plan = Counter()
    for x in mixing.mix(few).collect():
        plan[x.doc_id] += x.copies
    assert Counter(x.doc_id for x in mix.collect()) == Counter({k: n for k, n in plan.items() if n})

    made = stage["tokenize"](spark, few, sf).collect()
    v = bpe.vocabulary(bpe._path(queries.VOCABULARY))
    assert sorted((str(x.doc_id), list(x.ids)) for x in made) == sorted((str(x.doc_id), v.library.encode(x.text or "", add_special_tokens=False).ids) for x in rows)
    for name, f in p.STAGES:
        assert f(spark, few.limit(0), sf).count() == 0, name
        nulls = spark.createDataFrame([(None,) * len(few.columns)] * 2, few.schema)
        assert f(spark, nulls, sf).count() <= 2, name


TAKEN = ["kept", "rest", "bundle", "z", "ends", "spots", "whole", "row", "copies", "n_bytes", "label", "th", "score", "predicted", "no", "src", "size", "h", "found", "n_tokens", "decoded"]


@pytest.mark.parametrize("name", ["quality_filter", "near_dedup", "repeat_dedup", "source_mixing", "tokenize"])
def test_stages_with_taken_names(spark, odd, sf, name):
    """Columns named like what a stage makes inside: they are carried (by tokenize, but for those named like its outputs)."""
    import corpus_pipeline as p

    df = odd.withColumns({c: F.lit("own") for c in TAKEN})
    out = dict(p.STAGES)[name](spark, df, sf)
    made = {"n_tokens", "decoded"} if name == "tokenize" else set()
    assert set(df.columns) - made - {"text"} <= set(out.columns)
    few = out.where(" and ".join(f"{c} = 'own'" for c in TAKEN if c not in made))
    assert few.count() == out.count() > 0
    if name != "tokenize":
        assert out.columns == df.columns


def test_repeats_keep_ids_and_columns(odd):
    out = repeats.without_repeats(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert math.isclose(out.where("text is null").count(), 0)
