"""Operators 11 to 13: brute force, forced collisions and overflow, incremental upkeep, taken names."""

import random
from collections import Counter, defaultdict
from hashlib import sha256
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_cases import sql
from test_operators import SCHEMA, odd_rows
from test_queries import table

from tidemark.llm import audit, cuckoo, divergence

UP = {ord(c): c.lower() for c in cuckoo.UP}


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    from tidemark.session import ship

    ship(spark)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).cache()


def keys_of(names):
    return np.frombuffer(b"".join(sha256(n.encode()).digest() for n in names), cuckoo.KEY).reshape(-1, 4)


def test_cuckoo_table_against_a_dict():
    r = random.Random(1)
    held, want, buckets = cuckoo.Cuckoo(), Counter(), set()
    for step in range(60):
        names = sorted({f"k{r.randrange(30_000)}" for _ in range(r.choice([1, 10, 3000]))})
        n = np.array([r.randrange(1, 4) for _ in names])
        if step % 3 == 2:
            held.remove(keys_of(names), n)
            want -= Counter(dict(zip(names, n.tolist(), strict=True)))
        else:
            held.add(keys_of(names), n)
            want += Counter(dict(zip(names, n.tolist(), strict=True)))
        buckets.add(len(held.tags))
        if step % 7 == 0:
            held = cuckoo.Cuckoo.unpack(*held.pack())
        every = [f"k{i}" for i in range(30_000)]
        at = held.find(keys_of(every))
        assert [int(held.counts[a]) if a >= 0 else 0 for a in at] == [want[k] for k in every]
        assert (held.tags != 0).sum() == len(want) == (held.slots >= 0).sum()  # a lane for each live key, none for others
    assert len(buckets) > 3  # overflow made it grow, again and again
    live = held.only(2)
    assert (live.tags != 0).sum() == sum(n > 1 for n in want.values())
    assert (live.find(keys_of([k for k, n in want.items() if n > 1])) >= 0).all()


def test_false_hits_are_verified_against_stored_keys():
    keys = keys_of(["a", "b"]).copy()
    keys[1, 1:3] = keys[0, 1:3]  # the same buckets and tag
    held = cuckoo.Cuckoo()
    held.add(keys[:1], np.array([1]))
    assert held.find(keys).tolist() == [0, -1]
    held.add(keys, np.array([1, 1]))
    held.remove(keys[:1], np.array([2]))
    assert held.find(keys).tolist() == [-1, 1]


def exact_brute(rows):
    """(doc_id, keep_id, group_size, kept, sha256) of each (doc_id, text), one row kept of each text."""
    by = defaultdict(list)
    for i, t in rows:
        by[(t or "").translate(UP)].append(i)
    out = []
    for t, ids in by.items():
        known = [i for i in ids if i is not None]
        ids = sorted(ids, key=lambda i: (i is not None, i or 0), reverse=True)
        out += [(i, max(known, default=None), len(ids), k == 0, sha256(t.encode()).hexdigest()) for k, i in enumerate(ids)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup_by_brute_force(spark, odd, monkeypatch, weak):
    """weak: few digests, so that texts share them and are told apart by their content; filters joined by shard."""
    digest = cuckoo.digest
    if weak:
        monkeypatch.setattr(cuckoo, "digest", lambda b: sha256(sha256(b).digest()[:1]).digest())
        monkeypatch.setattr("tidemark.llm.common.BROADCAST_BYTES", 0)
    r = random.Random(4)
    texts = ["same", "SAME", "sAmé", "sAMé", "samÉ", "", None, " ", "x" * 5000, "X" * 5000] + [f"text {i}" for i in range(300)]
    rows = [(r.randrange(10**6), r.choice(texts)) for _ in range(1500)] + [(5, "hot")] * 900 + [(None, "none"), (None, "NONE"), (None, "hot"), (7, "seven"), (7, "seven"), (7, "other seven")]
    rows += [(x.doc_id, x.text) for x in odd.collect()]
    r.shuffle(rows)
    names = ["key", "shard", "tag", "hit", "keep_id", "row", "all", "body", "kept"]
    df = spark.createDataFrame([(*x, *["own"] * len(names)) for x in rows], "doc_id long, text string, " + ", ".join(f"{c} string" for c in names)).repartition(5)
    want = exact_brute(rows)
    got = sorted(((x.doc_id, x.keep_id, x.group_size, x.kept, x.text_sha256) for x in cuckoo.duplicates(df).collect()), key=repr)
    if weak:
        got, want = ([x[:4] for x in y] for y in (got, want))
        got, want = sorted(got, key=repr), sorted(want, key=repr)
    assert got == want
    last = cuckoo.keep_last(df)
    assert last.columns == df.columns
    kept = sorted(((x.doc_id, (x.text or "").translate(UP)) for x in last.where("hit = 'own' and body = 'own'").collect()), key=repr)
    by = {t for _, t in rows}
    top = {(t or "").translate(UP): None for t in by}
    for i, t in rows:
        t = (t or "").translate(UP)
        top[t] = i if top[t] is None else top[t] if i is None else max(i, top[t])
    assert kept == sorted(((i, t) for t, i in top.items()), key=repr)
    assert cuckoo.duplicates(df.limit(0)).count() == cuckoo.keep_last(df.limit(0)).count() == 0
    assert digest(b"") == sha256().digest()


def test_index_follows_batches(spark, odd):
    rows = [(i, f"Text {i % 40}" if i % 5 else None) for i in range(400)]
    batch = lambda a, z: spark.createDataFrame(rows[a:z], "doc_id long, text string")
    index = cuckoo.insert(None, batch(0, 200), 64)
    index = cuckoo.insert(index, batch(200, 400), 64)
    index = cuckoo.delete(index, batch(0, 300), 64)
    index = cuckoo.delete(index, spark.createDataFrame([(0, "never there")], "doc_id long, text string"), 64)
    left = Counter((t or "").lower() for _, t in rows[300:])
    asked = spark.createDataFrame([*rows[:45], (900, "never there"), (901, "TEXT 7")], "doc_id long, text string")
    got = {x.doc_id: x.n for x in cuckoo.live_count(index, asked, 64).collect()}
    assert got == {x.doc_id: left[(x.text or "").lower()] for x in asked.collect()}
    index = cuckoo.delete(index, batch(300, 400), 64)
    assert cuckoo.repeated_tags(index, 1).count() == 0


def test_audit_by_brute_force(spark, odd, monkeypatch):
    """Every order by removing documents one filter after the other."""
    docs = [(x.doc_id, x.text, x.lang) for x in odd.collect()]
    r = random.Random(2)
    docs += [(100 + i, r.choice(["# a", "A B C D", "the " * 120, " ".join(f"w{k}" for k in range(150)), " ".join(f"w{k}" for k in range(150)) + "X" * 200, None]), r.choice(["en", "", None])) for i in range(80)]
    labels = [(100 + i, i % 2, i % 3 == 0) for i in range(0, 80, 2)] + [(102, 1, 1), (103, 0, 1), (None, 1, 1)]
    df, lab = spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame([(i, q, int(t)) for i, q, t in labels], "doc_id long, quality int, toxic int")
    blank = "\x20\x09\x0a\x0b\x0c\x0d"
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))

    def fails(i, t):
        t = t or ""
        w = [x for x in t.translate({ord(c): " " for c in blank}).split(" ") if x]
        tests = (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in t) > 10 * len(t), any(c in "#$%&*|" for c in t), i is not None and first[t] < i)
        return {f for f, x in zip("ABCDE", tests, strict=True) if x}

    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t}
    by = defaultdict(list)
    for i, t, lang in docs:
        by[lang or ""].append((i, fails(i, t)))
    want = {}
    for part, rows in by.items():
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = rows
            for k, f in enumerate(order):
                out, left = [x for x in left if f in x[1]], [x for x in left if f not in x[1]]
                shapley[f] += len(out)
                want[part, "".join(order), k + 1] = [len(left), len(out), sum(f in m for _, m in rows) - len(out), sum(m == {f} for _, m in rows), sum(i in good for i, _ in out if i is not None), sum(i in toxic for i, _ in out if i is not None)]
        for (p, o, k), v in want.items():
            if p == part:
                v.append(shapley[o[k - 1]])

    def found():
        return {(x.part, x.filter_order, x.step): [x.kept, x.removed, x.redundant, x.unique_fails, x.good_lost, x.toxic_lost, x.shapley] for x in audit.audit(df, lab).collect()}

    assert found() == want
    monkeypatch.setattr(audit, "_split", lambda key, block: F.pmod(F.xxhash64(key, block), F.lit(3)))  # classes stay mixed: full texts decide
    assert found() == want
    assert audit.audit(df.limit(0), lab).count() == 0


def test_refinement_reads_whole_texts(spark):
    """Texts that differ in their last character alone, in lengths about the blocks' ends."""
    rows = []
    for n in (0, 1, 63, 64, 65, 255, 256, 257, 1024, 1025, 70_000):
        rows += [(len(rows), "é" * n), (len(rows) + 1, "é" * n), (len(rows) + 2, "é" * max(n - 1, 0) + "x")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, lang string")
    again = {x.doc_id for x in audit.masks(df).where("mask & 16 <> 0").collect()}
    texts = [t for _, t in rows]
    assert again == {i for i, t in rows if texts.index(t) < i}
    keys = audit.profiled(df).select("key").distinct().count()
    assert keys == len(set(texts))


@pytest.mark.parametrize("light", [0, 3, 1000])
def test_divergence_with_many_sources(spark, odd, tmp_path, monkeypatch, light):
    """All terms heavy, some, and none; several blocks of sources and terms."""
    for name, n in (("LIGHT", light), ("LIGHT_SHARE", 10**6), ("SOURCE_BLOCK", 4), ("TERM_BLOCK", 7), ("CHUNK", 2000)):
        monkeypatch.setattr(divergence, name, n)
    r = random.Random(6)
    word = [f"{chr(97 + k % 26)}{chr(97 + k // 26)}é" for k in range(60)] + ["Ähre", "ähre", "ß", "日本", "a1b"]
    rows = [(i, " ".join(r.choice(word[: 5 + s * 4]) for _ in range(r.randrange(40))), r.choice(["x", "y"]), f"s{s}") for i in range(700) for s in [r.randrange(13)]]
    rows += [(1, None, "x", "no text"), (2, "alone", "z", "one"), (3, "", None, None), (4, "A-b A", None, "two"), (None, "aaé bbé", "x", None), (5, "12 34", "y", "s1")]
    rows += [(x.doc_id, x.text, x.lang, x.source) for x in odd.collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    df.write.parquet(f"{tmp_path}/documents")
    want, columns = sql({"documents": f"{tmp_path}/documents/*.parquet"}, divergence.SQL)
    got = divergence.divergence(df.withColumns({c: F.lit("own") for c in ("term", "n", "docs", "p", "no")}))
    order = sorted(got.columns)
    assert sorted(columns) == order
    assert table(got.collect(), got.columns, order) == table(want, columns, order)
    assert divergence.divergence(df.limit(0)).count() == 0


def test_shares_beyond_64_bits(spark):
    n = 3 * 10**13
    df = spark.createDataFrame([(n, 7 * n, 11)], "n long, total long, terms long")
    assert df.select(divergence.share("n", "total", "terms").alias("p")).first().p == 1 + 10**9 * (n + 5) // (7 * n + 55)
