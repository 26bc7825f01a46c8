"""Nearest neighbours by graphs: measured against brute force."""

import math

import numpy as np
import pytest

from sightline.llm import graphindex

SF = "/root/testdata/sf0.01"
KIND = "vec_id long, embedding array<float>"
ASKED = "vec_id % 20 = 0"


def _product(v, w):
    """Products added in order (``sum`` corrects rounding)."""
    total = 0.0
    for a, b in zip(v, w, strict=True):
        total += a * b
    return total


def _exact(rows, k):
    """{query: [(id, score)]} by comparing all pairs."""
    once = {}
    for i, v in rows:
        if i is None or v is None or not len(v) or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        once[i] = min(once.get(i, v), v)
    out = {}
    for q, v in once.items():
        if q % 20 == 0:
            others = [(i, _product(v, w)) for i, w in once.items() if i != q and len(w) == len(v)]
            out[q] = sorted(others, key=lambda x: (-x[1], x[0]))[:k]
    return out


def _found(frame):
    out = {}
    for r in frame.orderBy("query_id", "rank").collect():
        own = out.setdefault(r.query_id, [])
        own.append((r.vec_id, r.score))
        assert r.rank == len(own)
    return out


def _recall(found, exact):
    assert set(found) <= set(exact)
    return sum(len({i for i, _ in found.get(q, [])} & {i for i, _ in e}) for q, e in exact.items()) / max(1, sum(map(len, exact.values())))


def _floats(rng, n, dim=24):
    return [[float(x) for x in v] for v in rng.normal(size=(n, dim)).astype(np.float32)]


@pytest.mark.parametrize("shards", [1, 3])
def test_recall_and_scores(spark, shards):
    rng = np.random.default_rng(2)
    rows = list(enumerate(_floats(rng, 1500)))
    exact = _exact(rows, 20)
    found = _found(graphindex.nearest(spark.createDataFrame(rows, KIND), ASKED, shards=shards))
    assert _recall(found, exact) > 0.95
    assert all(len(f) == 20 for f in found.values())
    vectors = dict(rows)
    for q, own in found.items():
        assert [s for _, s in own] == [_product(vectors[q], vectors[i]) for i, _ in own]
        assert own == sorted(own, key=lambda x: (-x[1], x[0]))


def test_lengths_that_differ_widely(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x * s)) for x in v]) for i, (v, s) in enumerate(zip(_floats(rng, 1200), np.exp(rng.normal(size=1200) * 2)))]
    assert _recall(_found(graphindex.nearest(spark.createDataFrame(rows, KIND), ASKED)), _exact(rows, 20)) > 0.9


def test_one_vector_under_a_third_of_the_ids(spark):
    rng = np.random.default_rng(4)
    vectors = _floats(rng, 900)
    rows = [(i, vectors[0] if i % 3 == 0 else v) for i, v in enumerate(vectors)]
    found, exact = _found(graphindex.nearest(spark.createDataFrame(rows, KIND), ASKED, shards=4)), _exact(rows, 20)
    for q in (q for q in exact if q % 3 == 0):
        assert found[q] == exact[q]  # ties go to the smaller ids
    assert _recall(found, exact) > 0.95


def test_every_node_is_reached():
    rng = np.random.default_rng(6)
    for spread in (0, 2, 5):
        points = graphindex.lifted(rng.normal(size=(700, 6)) * np.exp(rng.normal(size=(700, 1)) * spread))
        links, entry = graphindex.built(points, degree=4, width=8)
        assert graphindex._reached(links, entry).all()
        assert all(len(set(row[row >= 0])) == (row >= 0).sum() and i not in row for i, row in enumerate(links))


def _unit(rng, n, dim=24):
    points = rng.normal(size=(n, dim))
    return points / np.linalg.norm(points, axis=1, keepdims=True)


def test_a_step_of_a_walk_looks_at_several_nodes(monkeypatch):
    points = _unit(np.random.default_rng(7), 1500)
    links, entry = graphindex.built(graphindex.lifted(points))
    sorts = []
    for name in ("partition", "argpartition"):
        real = getattr(np, name)
        monkeypatch.setattr(graphindex.np, name, lambda *a, real=real, **b: sorts.append(1) or real(*a, **b))
    found = graphindex.walked(points, links, np.array([entry]), points[:16], 64)[0]
    assert len(sorts) < 50  # node by node, each of the beam takes one
    best = np.argsort(-(points[:16] @ points.T), axis=1)[:, :20]
    assert np.mean([np.isin(b, f).mean() for b, f in zip(best, found, strict=True)]) > 0.95


def test_nodes_are_pruned_a_few_times_each_while_the_graph_grows(monkeypatch):
    points, rows, deep, real = graphindex.lifted(_unit(np.random.default_rng(8), 1500)), [], [], graphindex.pruned

    def counted(points, own, *rest):
        rows.extend([0] if deep else [len(own)])
        deep.append(1)
        try:
            return real(points, own, *rest)
        finally:
            deep.pop()

    monkeypatch.setattr(graphindex, "pruned", counted)
    monkeypatch.setattr(graphindex, "BATCH", 16)
    links, _ = graphindex.built(points)
    assert sum(rows) < 6 * len(points)
    assert links.shape[1] >= graphindex.DEGREE and (links >= 0).sum(axis=1).max() <= links.shape[1]


def test_a_walk_that_holds_all_nodes_finds_all():
    rng = np.random.default_rng(9)
    points = _unit(rng, 300, 6)
    links, entry = graphindex.built(graphindex.lifted(points), degree=5, width=10)
    for width in (1, 7, 300, 512):
        found, visited = (lambda out: (out[0], out[-1]))(graphindex.walked(points, links, np.array([entry]), points[:40], width))
        for f, v in zip(found, visited, strict=True):
            f, v = f[f >= 0], v[v >= 0]
            assert len(set(f)) == len(f) and len(set(v)) == len(v) and set(f) <= set(v)
            assert len(f) == min(width, 300)


def test_pruning_takes_the_nearest_that_no_nearer_one_hides():
    rng = np.random.default_rng(10)
    points, relax = _unit(rng, 400, 3), 1.2
    for wide in (6, 60, 200):
        own = rng.choice(400, 30, replace=False)
        proposed = np.array([rng.choice(400, wide, replace=False) for _ in own])
        proposed[rng.random(proposed.shape) < 0.2] = -1
        out = graphindex.pruned(points, own, proposed, 5, relax)
        for o, candidates, got in zip(own, proposed, out, strict=True):
            away = lambda i, j: max(2 - 2 * float(points[i] @ points[j]), 0)
            left, kept = sorted((c for c in candidates if c >= 0 and c != o), key=lambda c: away(c, o)), []
            while left and len(kept) < 5:
                kept.append(left[0])
                left = [c for c in left[1:] if relax * relax * away(kept[-1], c) > away(c, o)]
            assert list(got[got >= 0]) == kept


def test_near_copies_and_values_of_any_size(spark):
    rng = np.random.default_rng(11)
    near = np.repeat(rng.normal(size=(3, 8)), 200, axis=0) + 1e-4 * rng.normal(size=(600, 8))
    for scale in (1.0, 1e30, 1e-30):
        rows = [(i, [float(np.float32(x * scale)) for x in v]) for i, v in enumerate(near)]
        found, exact = _found(graphindex.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), ASKED, shards=1)), _exact(rows, 20)
        assert _recall(found, exact) > 0.95
        assert all(f[0][1] == exact[q][0][1] for q, f in found.items())


def test_shards_of_bounded_size(spark):
    rows = list(enumerate(_floats(np.random.default_rng(5), 400, 8)))
    vectors = graphindex.usable(spark.createDataFrame(rows, KIND))
    shards = graphindex.shards_of(vectors, 2, 8 * 9 * 50)
    assert shards == 8
    index = graphindex.indexed(vectors, shards, degree=6).collect()
    assert sorted(i for r in index for i in r.ids) == list(range(400))
    assert sum(len(r.links) for r in index) <= 6.5 * len(index) and all(r.node not in r.links for r in index)
    picked = vectors.where(ASKED)
    found = _found(graphindex.searched(graphindex.indexed(vectors, shards), picked, 5, block=7))
    assert _recall(found, _exact(rows, 5)) > 0.95


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (20, [0.0, 0.0]), (40, None), (60, []), (80, [nan, 1.0]), (100, [inf, 1.0]), (120, [None, 1.0]),
            (None, [1.0, 1.0]), (1, [1.0, 2.0]), (2, [-1.0, 3.0]), (2, [-2.0, 9.0]), (-20, [5.0, 1.0]), (140, [1.0, 2.0, 3.0]), (141, [1.0, 2.0, 4.0]), (160, [7.0])]
    wide = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], KIND + ", shard int, dim int, node int, score int")
    exact = _exact(rows, 20)
    assert _found(graphindex.nearest(wide, ASKED)) == {q: e for q, e in exact.items() if e}
    assert graphindex.nearest(wide.limit(0), ASKED).collect() == []
    assert graphindex.nearest(wide.where("vec_id = 20"), ASKED).collect() == []


def test_query(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    found = _found(graphindex.query(spark, SF))
    assert _recall(found, _exact(rows, 20)) > 0.98
    assert set(found) == {i for i, _ in rows if i % 20 == 0}
