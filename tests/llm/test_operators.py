"""The corpus operators against brute force, exact round trips and held-out accuracy, on whole small tables."""

import math
import random
import re
from collections import Counter
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, extract, fingerprint, katz, minhash, mixing, quality, queries, repeats, search, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, size long, label string, row long, key string, block long"


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def odd_rows():
    """Nulls, empty, blank, short and very long texts, repeated rows, near copies, shared passages."""
    r = random.Random(3)
    say = lambda n: " ".join(f"w{r.randrange(4000)}" for _ in range(n))
    base, passage = say(80), say(60)
    near = base.split()
    near[40] = "changed"
    texts = [None, "", " \t\n", "one", "One TWO three", base, base, " ".join(near), say(30) + " " + passage + " " + say(30), passage + " " + say(5), say(30_000), "é" * 300, "x" * 5000, "a b c d e f", "a b c d e f", base.upper()]
    return [(i if i != 3 else None, t, "en", (None, "a", "b", "c")[i % 4], None, 7, "z", 1, None, 2) for i, t in enumerate(texts)] + [(5, base, "en", "b", None, 7, "z", 1, None, 2)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    from tidemark.session import ship

    ship(spark)
    return spark.read.parquet(f"{sf}/documents.parquet")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def near_brute(rows):
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    top = list(range(len(rows)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                top[root(i)] = root(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[root(i)] = min(d, ids.get(root(i), d))
    return sorted((-1 if d is None else d, len(sets[i]), -1 if ids.get(root(i)) is None else ids[root(i)]) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_near_duplicates(which, request):
    df = request.getfixturevalue(which)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in minhash.near_duplicates(df).collect())
    assert got == near_brute([(r.doc_id, r.text) for r in df.collect()])


def test_near_copies_leave_one(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    blank = sum(not words(t) for _, t in rows)
    named = {(c, c == -1 and d) for (d, n, c) in near_brute(rows) if n}
    assert minhash.drop_near_duplicates(odd).count() == blank + len(named)
    assert minhash.drop_near_duplicates(odd.limit(0)).columns == odd.columns


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_bpe_is_exact(which, request):
    from tokenizers import Tokenizer

    df = request.getfixturevalue(which)
    t = Tokenizer.from_file(bpe._path(queries.VOCABULARY))
    for r in bpe.encode(df.select("text"), queries.VOCABULARY, keep=["text"]).collect():
        want = t.encode(r.text or "", add_special_tokens=False).ids
        assert list(r.ids) == want and r.n_tokens == len(want)
        assert r.decoded == t.decode(want, skip_special_tokens=False)


def test_bpe_odd_strings(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe._path(queries.VOCABULARY))
    r = random.Random(1)
    texts = ["<|endoftext|>x<|startoftext|>", "İstanbul ẞ ſ K", "中文 字", "a b c", "é", "12345 ½ ²", "I'LL don't 'S", "😀👨‍👩‍👧", "\x00\x01 \x1c", "ﬁ ǅ"]
    texts += ["".join(r.choice("abcdefghij 'stre\nÉß9中😀.,!-") for _ in range(r.randrange(60))) for _ in range(300)]
    df = spark.createDataFrame([(x,) for x in texts], "text string")
    for row in bpe.encode(df, queries.VOCABULARY, keep=["text"]).collect():
        assert list(row.ids) == t.encode(row.text, add_special_tokens=False).ids, repr(row.text)


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_repeats(which, request):
    df = request.getfixturevalue(which)
    rows = [(r.doc_id, (r.text or "").encode()) for r in df.select("doc_id", "text").collect()]
    count = Counter(b[i : i + 200] for _, b in rows for i in range(len(b) - 199))
    want = []
    for d, b in rows:
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if count[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want.append((str(d), len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha256(left).hexdigest()))
    out = repeats.remove_repeats(df.select("doc_id", "text"), ("n_bytes", "n_removed", "n_spans", "kept_sha256"))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out.collect()) == sorted(want)


def test_counted_spans_equal_sorted_spans(docs, monkeypatch):
    want = sorted(map(tuple, repeats.remove_repeats(docs.select("doc_id", "text"), ("n_removed", "kept_sha256")).collect()))
    monkeypatch.setattr(repeats, "CROWD", 2)
    assert sorted(map(tuple, repeats.remove_repeats(docs.select("doc_id", "text"), ("n_removed", "kept_sha256")).collect())) == want


def katz_brute(rows):
    """Scores, and the sum of all events' probabilities after each of some contexts."""
    toks = [(d, [*words(t), None]) for d, t in rows]
    train = [t for d, t in toks if crc32(("" if d is None else str(d)).encode()) % 5 != 1]
    c1 = Counter(w for t in train for w in t)
    c2 = Counter(p for t in train for p in zip(["<b>", *t[:-1]], t, strict=True))
    total, types, cut = sum(c1.values()), len(c1), katz.CUT
    hist = lambda c: np.bincount([min(n, cut + 2) for n in c.values()], minlength=cut + 3)
    k1, k2 = katz.discounts(hist(c1)), katz.discounts(hist(c2))
    kept = lambda k, n: (k[n] if n <= cut else 1.0) * n
    mass = sum(kept(k1, n) for n in c1.values())
    unseen = max(1 - mass / total, 0.5 / (total + 1))
    p1 = lambda w: kept(k1, c1[w]) * (1 - unseen) / mass if w in c1 else unseen
    after = {}
    for (a, b), n in c2.items():
        after.setdefault(a, {})[b] = n
    ctx = lambda a: len(train) if a == "<b>" else c1[a]

    def weights(a):
        seen = after.get(a, {})
        m = sum(kept(k2, n) for n in seen.values()) / max(ctx(a), 1)
        f = min(1.0, ctx(a) / (ctx(a) + 1) / m) if m else 1.0
        return seen, f, (1 - f * m) / (1 - sum(map(p1, seen))) if seen else 1.0

    def p(a, b):
        seen, f, w = weights(a)
        return f * kept(k2, seen[b]) / ctx(a) if b in seen else w * p1(b)

    sums = [sum(p(a, b) for b in c1) + p(a, "never seen") for a in sorted(after, key=str)[:5]]
    out = {d: (len(t), sum(w in c1 for w in t), total, sum(math.log10((c1[w] + 0.5) / (total + 0.5 * (types + 1))) for w in t), sum(math.log10(p(a, b)) for a, b in zip(["<b>", *t[:-1]], t, strict=True))) for d, t in toks}
    return out, sums


def test_katz(spark, sf, docs):
    want, sums = katz_brute([(r.doc_id, r.text) for r in docs.collect()])
    assert sums == pytest.approx([1.0] * len(sums))
    got = by_id(katz.score_texts(docs.select("doc_id", "text", (quality.fold() != 1).alias("train"))))
    shown = by_id(queries.op7_katz(spark, sf))  # rounded
    for d, w in want.items():
        g = got[d]
        assert (g.n_tokens, g.n_known, g.train_tokens) == w[:3]
        assert (g.base_score, g.score) == pytest.approx(w[3:], rel=1e-9)
        assert (shown[d].base_score, shown[d].score) == pytest.approx(w[3:], rel=1e-9, abs=1e-7)


def test_katz_hot_contexts_are_dealt_out(spark, sf, monkeypatch):
    want = {d: r.score for d, r in by_id(queries.op7_katz(spark, sf)).items()}
    monkeypatch.setattr(katz, "HOT", 1000)
    got = {d: r.score for d, r in by_id(queries.op7_katz(spark, sf)).items()}
    assert got == pytest.approx(want)


def test_sorted_packing():
    x = np.sort(np.random.default_rng(1).integers(0, 1 << 64, 1000, dtype=np.uint64))
    assert (katz.unpack_sorted(katz.pack_sorted(x)) == x).all()
    assert not len(katz.unpack_sorted(katz.pack_sorted(x[:0])))


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_mixing(which, request):
    df = request.getfixturevalue(which)
    rows = mixing.mix(df).collect()
    sizes = Counter()
    for r in df.collect():
        sizes[r.source] += len(WORD.findall(r.text or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    full, target = set(), {}
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        free = sum(w for s, w in weight.items() if s not in full)
        target = {s: 3 * sizes[s] if s in full else left * weight[s] / free for s in order}
        over = {s for s in order if target[s] > 3 * sizes[s]} - full
        if not over:
            break
        full |= over
    assert {round(r.target, 6) for r in rows} == {round(t, 6) for t in target.values()}
    assert {(r.source_size) for r in rows} == set(sizes.values())
    assert all(r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0) for r in rows)
    taken, biggest = Counter(), Counter()
    for r in rows:
        key = r.source_size, r.target
        taken[key] += r.taken
        biggest[key] = max(biggest[key], r.size)
    if which == "docs":
        assert len(taken) == len(sizes) and all(abs(taken[k] - k[1]) <= biggest[k] for k in taken)
    again = mixing.mix(df.repartition(3)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_fingerprints(which, request):
    df = request.getfixturevalue(which)
    rows = sorted(((r.doc_id, r.text or "") for r in df.collect()), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    want = []
    for (d, t), (_, u) in zip(rows, rows[1:] + rows[:1], strict=True):
        n = len(t) // 3
        want.append((str(d), len(t), sha256((t[: len(t) - n] + u[:n]).encode()).hexdigest()))
    got = fingerprint.fingerprint_edited(df).collect()
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    assert all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next))
    prints = {}
    for r, t in zip(fingerprint.fingerprint(df).select("text", "fingerprint").collect(), [None] * len(rows), strict=True):
        assert prints.setdefault(r.text or "", r.fingerprint) == r.fingerprint


def test_shared_runs_share_an_entry(spark):
    r = random.Random(2)
    say = lambda n: [str(r.randrange(10**6)) for _ in range(n)]
    for _ in range(5):
        run = say(fingerprint.K + fingerprint.W - 1)
        df = spark.createDataFrame([(" ".join(say(r.randrange(20)) + run + say(r.randrange(20))),) for _ in range(2)], "text string")
        a, b = ({x.split(":")[1] for x in row.fingerprint.split()} for row in fingerprint.fingerprint(df).collect())
        assert a & b


def test_search(spark, sf, docs):
    rows = [(r.doc_id, Counter(words(r.text))) for r in docs.collect()]
    df = Counter(w for _, c in rows for w in c)
    n, mean = len(rows), sum(sum(c.values()) for _, c in rows) / len(rows)
    want = {}
    for q, qc in rows:
        if q % 100 == 0:
            scores = []
            for d, c in rows:
                norm = search.K1 * (1 - search.B + search.B * sum(c.values()) / mean)
                s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * (search.K1 + 1) / (c[w] + norm) for w in qc if c[w])
                if s > 0:
                    scores.append((d, s))
            want[q] = sorted(scores, key=lambda x: (-round(x[1], 9), x[0]))[:10]
    got = {}
    for r in queries.op10_search(spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    assert got.keys() == want.keys()
    for q in want:
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]])
        assert {d for d, s in got[q] if s > want[q][-1][1] + 1e-9} == {d for d, s in want[q] if s > want[q][-1][1] + 1e-9}


def test_url_rules_and_bloom(spark):
    rules = spark.createDataFrame(queries.RULES, "host string, path string, verdict string")
    listed = spark.createDataFrame([("spam.org", ""), ("a.b.org", "/x")], "host string, path string")
    urls = ["http://www.Example.com/en/a?q", "https://example.com/en/", "http://example.com/de", "http://x.com", "ftp://u.net/es/1", "http://spam.org#f", "http://sub.spam.org/z", "http://notspam.org/", "http://a.b.org/xyz", "http://a.b.org/y", "nourl", "", None, "http://", "http://www.example.com/en/"]
    got = [(r.url, r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(spark.createDataFrame([(u,) for u in urls], "url string"), rules, listed).collect()]
    want = {
        urls[0]: ("www.example.com", "/en/a", "www.example.com/en/", "allow"), urls[1]: ("example.com", "/en/", "example.com/en/", "block"), urls[2]: ("example.com", "/de", "com/", "allow"),
        urls[3]: ("x.com", "", None, "allow"), urls[4]: ("u.net", "/es/1", "net/es/", "block"), urls[5]: ("spam.org", "", None, "block"), urls[6]: ("sub.spam.org", "/z", None, "block"),
        urls[7]: ("notspam.org", "/", None, "allow"), urls[8]: ("a.b.org", "/xyz", None, "block"), urls[9]: ("a.b.org", "/y", None, "allow"), "nourl": ("", "", None, "allow"), "": ("", "", None, "allow"),
        None: ("", "", None, "allow"), "http://": ("", "", None, "allow"), urls[14]: ("www.example.com", "/en/", "www.example.com/en/", "allow"),
    }
    assert len(got) == len(urls) and all(want[u] == tuple(rest) for u, *rest in got), [(u, rest) for u, *rest in got if want[u] != tuple(rest)]


def test_extraction(spark):
    page = "<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><div class='cookie-notice'>We use cookies</div><article><h1>Big &amp; small</h1><p>First   paragraph, with\n <b>bold</b> text and some words to read.</p><aside class='related'><a href='/x'>More like this</a></aside><p>Second &#8212; paragraph of the story, which goes on.</p></article><div class='comments'><p>Nice post!</p></div><footer>Copyright</footer></body></html>"
    df = spark.createDataFrame([(1, page, "x"), (2, None, "x"), (3, "", "x"), (4, page, "x")], "page_id long, html string, text string")
    got = {r.page_id: r for r in extract.extract(df).collect()}
    assert got[1].text == got[4].text == "Big & small First paragraph, with bold text and some words to read. Second — paragraph of the story, which goes on."
    assert got[2].text == got[3].text == "" and got[1].n_chars == len(got[1].text)


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op4_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out and quality is not null").collect()
    right = sum((r.score >= 0.5) == (r.quality == 1) for r in got)
    assert right / len(got) > 0.85
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)


def run_all(spark, docs):
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("quality"))
    yield quality.classify(docs, quality.fit(docs, labels)), True
    yield quality.classify(docs, quality.fit(docs, labels.limit(0))), True
    yield minhash.near_duplicates(docs), True
    yield bpe.encode(docs, queries.VOCABULARY), True
    yield repeats.remove_repeats(docs), True
    yield repeats.without_repeats(docs), True
    yield katz.score_texts(docs.withColumn("train", quality.fold() != 1)), True
    yield mixing.mix(docs), True
    yield fingerprint.fingerprint(docs), True
    yield fingerprint.fingerprint_edited(docs), True
    yield extract.extract(docs.withColumnRenamed("text", "html")), True
    yield url_filter.filter_urls(docs.withColumnRenamed("text", "url"), spark.createDataFrame(queries.RULES, "host string, path string, verdict string"), spark.createDataFrame([], "host string, path string")), True
    yield mixing.mixed(docs), False
    yield search.top_k(docs, docs.where(search.is_query()).select(F.col("doc_id").alias("query_id"), "text")), False


def test_odd_rows_run_through_everything(spark, odd):
    for df, same in run_all(spark, odd):
        n = df.count()
        assert not same or n == len(odd_rows()), df.columns


def test_empty_tables(spark, odd):
    for df, _ in run_all(spark, odd.limit(0)):
        assert df.count() == 0, df.columns


def test_all_null(spark):
    df = spark.createDataFrame([(None,) * 10] * 2, SCHEMA)
    for out, same in run_all(spark, df):
        assert not same or out.count() == 2, out.columns
