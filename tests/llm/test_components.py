"""Connected components against a union-find, and what their rounds carry along."""

import random

import pytest

from tidemark.llm import graph


def brute(edges):
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            top[x] = x = top[top[x]]
        return x

    for u, v in edges:
        if u != v:
            a, b = find(u), find(v)
            top[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(top)}


def labels(spark, edges):
    return dict(map(tuple, graph.components(spark.createDataFrame(edges, "u long, v long")).select("node", "label").collect()))


def shapes():
    r = random.Random(4)
    path = list(range(40))
    mixed = r.sample(path, 40)
    yield "none", []
    yield "loops", [(3, 3), (-2, -2)]
    yield "path", list(zip(path, path[1:]))
    yield "mixed path", [(b, a) for a, b in zip(mixed, mixed[1:])]
    yield "many", [(r.randrange(-400, 400), r.randrange(-400, 400)) for _ in range(350)]


@pytest.mark.parametrize("edges", [e for _, e in shapes()], ids=[n for n, _ in shapes()])
def test_components_equal_a_union_find(spark, edges):
    assert labels(spark, edges) == brute(edges)


def test_a_group_is_carried_once(spark, monkeypatch):
    """All of a large group linked with two heads: its links are written once, and no later round reads them again."""
    written, real = {}, graph.stored

    def counted(df, name):
        out = real(df, name)
        written.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(graph, "stored", counted)
    edges = [(head, k) for head in (7, 11) for k in range(100, 2100)]
    assert set(labels(spark, edges).values()) == {7}
    assert written["links"] == [len(edges), 1, 0]
