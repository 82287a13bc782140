"""The graph index against a scan of everything."""

import numpy as np

from vellum.operators import graph_index, retrieval


def _clustered(rng, n, dim):
    centres = rng.normal(size=(30, dim))
    return centres[rng.integers(0, 30, n)] + 0.5 * rng.normal(size=(n, dim))


def test_walks_find_most_and_all_with_a_full_beam():
    rng = np.random.default_rng(4)
    x = _clustered(rng, 3000, 16)
    x[7:10] = x[6]
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    queries = unit[::30]
    links = graph_index.links_of(unit)
    want = np.argsort(-(queries @ unit.T), axis=1, kind="stable")[:, :10]
    found, sims, looked = graph_index.walk(unit, links, queries, 64)
    assert np.mean([len(set(f[:10]) & set(w)) / 10 for f, w in zip(found, want, strict=True)]) >= 0.95
    assert looked < 0.4 * len(queries) * len(unit) and (np.diff(sims, axis=1) <= 0).all()
    assert all(len(set(f)) == len(f) for f in found)
    every, _, _ = graph_index.walk(unit, links, queries[:5], len(unit))
    assert all(set(f) == set(range(len(unit))) for f in every)
    assert graph_index.links_of(unit[:1]).max() == 0 and graph_index.walk(unit[:1], graph_index.links_of(unit[:1]), queries[:2], 5)[0].tolist() == [[0], [0]]


def test_a_full_beam_needs_no_steps():
    """A beam of all rows takes every product once; before, it went a step for each row, with a sort of the beam in each, along the links."""
    rng = np.random.default_rng(7)
    x = _clustered(rng, 2000, 8)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    nowhere = np.repeat(np.arange(2000)[:, None], 5, axis=1)
    rows, sims, looked = graph_index.walk(unit, nowhere, unit[:9], 2000)
    assert (np.sort(rows, axis=1) == np.arange(2000)).all() and looked == 9 * 2000
    assert (np.diff(sims, axis=1) <= 0).all() and np.allclose(sims, np.einsum("id,ijd->ij", unit[:9], unit[rows]))


def test_links_back_are_those_that_come_first():
    rng = np.random.default_rng(8)
    unit = _clustered(rng, 500, 4)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    links = graph_index.links_of(unit, near=6, far=2)
    nearest, back = links[:, :6], links[:, 6:12]
    for b in range(500):
        want = [a for a in range(500) if b in nearest[a]][:6]
        assert back[b].tolist() == want + [b] * (6 - len(want))


def test_index_against_exact_search(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(graph_index, "BLOCK", 300)
    rng = np.random.default_rng(6)
    rows = [(i, "t" if i % 4 else "u", [float(c) for c in v]) for i, v in enumerate(_clustered(rng, 1500, 8))]
    odd = [(9001, "t", None), (9002, "t", [0.0] * 8), (9003, "t", [None, *[1.0] * 7]), (9004, None, [1.0] * 8), (9005, "t", [1.0, 2.0]), (9006, "t", [float("nan")] * 8)]
    schema = "id long, tenant string, vector array<double>"
    vectors = spark.createDataFrame(rows + odd, schema)
    index = graph_index.GraphIndex(spark, f"{tmp_path}/graph")
    queries = spark.createDataFrame([(i, t, v) for i, t, v in rows[::50]] + [(9001, "t", None), (9005, "t", [2.0, 4.0]), (9009, "none", [1.0] * 8)], "query_id long, tenant string, vector array<double>")
    assert index.nearest(queries, 5).count() == 0
    index.add(vectors.where("id % 3 <> 1"))
    index.add(vectors.where("id % 3 = 1"))
    exact = retrieval.nearest(vectors.where("id <> 9002 and id <> 9006"), queries, 5)
    full = index.nearest(queries, 5, beam=2000)
    tuples = lambda df: sorted((r["query_id"], r["id"], r["similarity"], r["rank"]) for r in df.collect())
    assert tuples(full) == tuples(exact)
    told = graph_index.recall(index.nearest(queries, 5), exact).first()
    assert told["neighbours"] == exact.count() and told["recall"] >= 0.95
    # a third part in single precision beside the others
    index.add(spark.createDataFrame([(9100, "t", [1.0, 0.5] * 4)], "id long, tenant string, vector array<float>"))
    one = spark.createDataFrame([(1, "t", [2.0, 1.0] * 4)], "query_id long, tenant string, vector array<double>")
    assert [tuple(r) for r in index.nearest(one, 1).collect()] == [(1, 9100, 1.0, 1)]
