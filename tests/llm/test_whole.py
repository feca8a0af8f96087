"""Cases in which an operator once did less than its whole job, against brute force."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import katz, minhash, search


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    from tidemark.session import ship

    ship(spark)


def katz_all(train, texts):
    """log10 scores of `texts`, from all bigrams of `train`; and the sum of all events' probabilities after each context."""
    ends = lambda t: [*t.split(), None]
    c1 = Counter(w for t in train for w in ends(t))
    c2 = Counter(p for t in train for p in zip(["<b>", *t.split()], ends(t), strict=True))
    total, cut = sum(c1.values()), katz.CUT
    hist = lambda c: np.bincount([min(n, cut + 2) for n in c.values()], minlength=cut + 3)
    k1, k2 = katz.discounts(hist(c1)), katz.discounts(hist(c2))
    kept = lambda k, n: (k[n] if n <= cut else 1.0) * n
    mass = sum(kept(k1, n) for n in c1.values())
    unseen = max(1 - mass / total, 0.5 / (total + 1))
    p1 = lambda w: kept(k1, c1[w]) * (1 - unseen) / mass if w in c1 else unseen

    def p(a, b):
        seen = {y: n for (x, y), n in c2.items() if x == a}
        n = len(train) if a == "<b>" else c1[a]
        m = sum(kept(k2, c) for c in seen.values()) / max(n, 1)
        f = min(1.0, n / (n + 1) / m) if m else 1.0
        return f * kept(k2, seen[b]) / n if b in seen else (1 - f * m) / (1 - sum(map(p1, seen))) * p1(b)

    sums = [sum(p(a, b) for b in c1) + p(a, "never seen") for a in {a for a, _ in c2}]
    return [sum(math.log10(p(a, b)) for a, b in zip(["<b>", *t.split()], ends(t), strict=True)) for t in texts], sums


@pytest.mark.parametrize("hot", [4, 1000])
def test_katz_keeps_bigrams_seen_once(spark, monkeypatch, hot):
    monkeypatch.setattr(katz, "HOT", hot)
    r = np.random.default_rng(5)
    train = [" ".join(f"w{int(x)}" for x in r.zipf(1.4, 30) if x < 400) for _ in range(60)] + ["once only here"]
    texts = [*train, "once only here", "only here once", "w1 once only w2 never w3", ""]
    df = spark.createDataFrame([(i, t, i < len(train)) for i, t in enumerate(texts)], "doc_id long, text string, train boolean")
    want, sums = katz_all(train, texts)
    assert sums == pytest.approx([1.0] * len(sums))
    got = {x.doc_id: x.score for x in katz.score_texts(df.repartition(3)).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx(want, rel=1e-9)


def test_packed_sums():
    x = np.random.default_rng(1).integers(0, 1 << 40, (9, katz.CUT + 2)).astype(float)
    x[:, -1] /= 1 << 41
    for rows in (x, x[:1], x[:0]):
        assert (katz.unpack_sums(np.frombuffer(katz.pack_sums(rows), np.uint8)) == rows).all()


def test_search_with_repeated_query_ids(spark):
    r = np.random.default_rng(7)
    say = lambda: " ".join(f"w{int(x)}" for x in r.integers(0, 30, 12))
    rows = [(i, say()) for i in range(1, 80)]
    first, second, third = say(), say(), say()
    rows += [(100, first)] * 3 + [(200, second), (200, third), (200, second)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    words = [(d, Counter(t.split())) for d, t in rows]
    has = Counter(w for _, c in words for w in c)
    mean = sum(sum(c.values()) for _, c in words) / len(words)
    want = []
    for q, text in ((100, first), (200, second), (200, third)):
        scores = []
        for d, c in words:
            norm = search.K1 * (1 - search.B + search.B * sum(c.values()) / mean)
            scores.append((-round(sum(math.log1p((len(words) - has[w] + 0.5) / (has[w] + 0.5)) * c[w] * (search.K1 + 1) / (c[w] + norm) for w in set(text.split()) if c[w]), 9), d))
        want += [(q, i + 1, d, -s) for i, (s, d) in enumerate(sorted(scores)[:10])]
    ask = df.where(search.is_query()).select(F.col("doc_id").alias("query_id"), "text")
    got = [(x.query_id, x.rank, x.doc_id, round(x.score, 9)) for x in search.top_k(df, ask).collect()]
    assert sorted(got) == sorted(want)


def test_search_passes_its_threshold_from_shards_to_shards(spark, monkeypatch):
    """20 shards and 79 queries in blocks and rounds: what shards return follows the queries, not shards times queries."""
    r = np.random.default_rng(11)
    say = lambda: " ".join(f"w{int(x)}" for x in r.integers(0, 90, 25))
    rows = [(i, say()) for i in range(1, 1200)]
    asked = [(i, rows[7 * i][1] if i % 2 else say()) for i in range(60)] + [(100 + i, rows[7][1]) for i in range(20)] + [(300, ""), (301, "nowhere")]
    docs, ask = spark.createDataFrame(rows, "doc_id long, text string").repartition(20), spark.createDataFrame(asked, "query_id long, text string")
    sent, found = [], []

    def searched(shards, blocks, least, *more, plain=search._searched):
        out = plain(shards, blocks, least, *more)
        sent.append([len(x) for x in least])
        found.append(out.count())
        return out

    monkeypatch.setattr(search, "_searched", searched)
    monkeypatch.setattr(search, "QUERIES", 20)
    monkeypatch.setattr(search, "ROUND_BYTES", 1)
    got = sorted((x.query_id, x.rank, x.doc_id, x.score) for x in search.top_k(docs, ask, 3).collect())
    has, mean = Counter(w for _, t in rows for w in set(t.split())), sum(len(t.split()) for _, t in rows) / len(rows)
    want = []
    for q, text in asked:
        scores = []
        for d, t in rows:
            c = Counter(t.split())
            norm = search.K1 * (1 - search.B + search.B * len(t.split()) / mean)
            s = sum(math.log1p((len(rows) - has[w] + 0.5) / (has[w] + 0.5)) * c[w] * (search.K1 + 1) / (c[w] + norm) for w in set(text.split()) if c[w])
            scores += [(-round(s, 9), d)] if s else []
        want += [(q, i + 1, d, -s) for i, (s, d) in enumerate(sorted(scores)[:3])]
    assert [x[:3] for x in got] == [x[:3] for x in sorted(want)] and [x[3] for x in got] == pytest.approx([x[3] for x in sorted(want)])
    texts = len({t for _, t in asked})
    assert len(sent) > 2 and sum(map(sum, sent)) == 2 * texts  # each different text once in each of two phases
    assert sum(found) < 0.5 * 20 * texts * 3


def test_search_phases_hold_every_shard_once():
    for n in (0, 1, 7, 8, 9, 64, 65, 300, 1425):
        phases = search._phases([3 * i for i in range(n)])
        assert sorted(x for phase in phases for x in phase) == [3 * i for i in range(n)] and all(phases)
        assert not n or len(phases[0]) <= search.STEP and all(len(b) <= 9 * sum(map(len, phases[: i + 1])) for i, b in enumerate(phases[1:]))


def test_equal_scores_rank_by_id_whatever_the_order_of_their_sums(spark):
    """Words come in pairs of equal shares; sums of the same five shares in different orders differ in the last bit. SQL rounds them before it ranks."""
    pair = lambda i, j: f"{'abcde'[j]}{i >> j & 1}"
    rows = [(i + 1, " ".join(pair(i, j) for j in range(5) for _ in range(j + 1))) for i in reversed(range(64))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    ask = spark.createDataFrame([(1, " ".join(pair(i, j) for i in (0, 31) for j in range(5)))], "query_id long, text string")
    assert [x.doc_id for x in search.top_k(df, ask, 12).orderBy("rank").collect()] == list(range(1, 13))


def test_unequal_minima_agree_by_chance():
    r = np.random.default_rng(3)
    for step in (1, 1 << 32, 2, (1 << 32) + 1):
        x = r.integers(0, 1 << 63, 200, dtype=np.uint64)
        a, b = (minhash.signatures(h, np.arange(len(h) + 1))[0] for h in (x, x ^ np.uint64(step)))
        assert abs(minhash.similarity(a, b).mean()) < 0.01, step


def test_links_are_hardly_ever_estimated_below_the_margin():
    limit, chance, n = minhash.NUMERATOR / minhash.DENOMINATOR, 2.0**-minhash.BITS, minhash.HASHES
    p, least = limit + (1 - limit) * chance, math.ceil(n * ((limit - minhash.MARGIN) * (1 - chance) + chance) - 1e-9)
    assert sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(least)) < 1e-9
