import numpy as np
import pyarrow as pa
import pytest

import lacustra as q
from lacustra.operators import components as C
from lacustra.operators import graph
from lacustra.operators.graph import components
from lacustra.operators.neighbors import box, gradient, opening

SHAPES = [
    ((5, 5), [(2, 2)], 2.0, 3.14159265, 1, 0),
    ((6, 7), [(r, c) for r in (2, 3) for c in (2, 3, 4)], 8.82842712, 0.96737407, 1.63299316, 0),
    ((6, 6), [(1, 1), (2, 1), (3, 1), (3, 2), (3, 3)], 9.41421356, 0.70894375, 1.88982237, 45),
    ((5, 7), [(2, c) for c in range(1, 6)], 8.0, 0.9817477, 1, 0),
    ((5, 5), [(r, c) for r in range(5) for c in range(5)], 0, 0, 1, 0),
]


def mask(shape, cells):
    m = np.zeros(shape, bool)
    for r, c in cells:
        m[r, c] = True
    return m


@pytest.mark.parametrize("shape,cells,perimeter,compactness,elongation,orientation", SHAPES)
def test_shapes(spark, shape, cells, perimeter, compactness, elongation, orientation):
    got = q.calculate_shape_metrics(q.from_numpy(spark, mask(shape, cells)))
    assert got["perimeter"] == pytest.approx(perimeter, abs=1e-6) and got["compactness"] == pytest.approx(compactness, abs=1e-6)
    assert got["elongation"] == pytest.approx(elongation, abs=1e-6) and got["orientation"] == pytest.approx(orientation, abs=1e-6) and got["area"] == len(cells)


def test_shapes_need_two_lines_and_may_be_empty(spark):
    with pytest.raises(ValueError):
        q.calculate_shape_metrics(q.from_numpy(spark, np.ones((1, 4), bool)))
    assert q.calculate_shape_metrics(q.from_numpy(spark, np.zeros((3, 3), bool)))["area"] == 0


def flood(m):
    """Labels by a search, in raster order."""
    out, n = np.zeros(m.shape, int), 0
    for start in zip(*np.nonzero(m), strict=True):
        if out[start]:
            continue
        n += 1
        todo = [start]
        while todo:
            r, c = todo.pop()
            if 0 <= r < m.shape[0] and 0 <= c < m.shape[1] and m[r, c] and not out[r, c]:
                out[r, c] = n
                todo += [(r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)]
    return out


def test_labels_equal_a_search_across_tiles(spark, monkeypatch):
    monkeypatch.setattr(C, "TILE", 7)
    m = np.random.default_rng(1).random((30, 33)) < 0.55
    got = np.zeros(m.shape, int)
    for r, c, i in C.label(q.from_numpy(spark, m)).collect():
        got[r, c] = i
    assert (got == flood(m)).all()


@pytest.mark.parametrize("together", [0, 1000])
def test_graph_components(spark, together):
    edges = spark.createDataFrame([(5, 9), (9, 7), (1, 2), (7, 30), (2, 1), (4, 4), (None, 3)], "a long, b long")
    assert sorted(map(tuple, components(edges, together).collect())) == [(1, 1), (2, 1), (5, 5), (7, 5), (9, 5), (30, 5)]
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    assert {r["root"] for r in components(chain, together).collect()} == {0}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_star_steps_are_few_and_of_three_shuffles(spark, monkeypatch):
    plans, kept = [], graph.staged
    monkeypatch.setattr(graph, "staged", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), kept(df))[1])
    rng = np.random.default_rng(3)
    name = rng.permutation(4000) * 7
    pairs = [(i, i + 1) for i in range(1500)] + [(1600, i) for i in range(1601, 2400)] + rng.integers(2500, 4000, (900, 2)).tolist()
    edges = [(int(name[a]), int(name[b])) for a, b in rng.permutation(pairs)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges + edges[:50], "a long, b long").repartition(8), 0).collect()}
    node, root = graph.roots_of(*np.array([e for e in edges if e[0] != e[1]]).T)
    assert got == dict(zip(node.tolist(), root.tolist(), strict=True))
    assert len(plans) <= 6 and all(p.count("Exchange hashpartitioning") <= 3 for p in plans)


def test_edges_of_a_task_are_contracted_in_bounded_parts(monkeypatch):
    monkeypatch.setattr(graph, "TOGETHER", 100)
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 200, (2, 950))
    u, v = np.maximum(a, b)[a != b], np.minimum(a, b)[a != b]
    parts = list(graph._contracted(pa.RecordBatch.from_arrays([pa.array(u[i : i + 30]), pa.array(v[i : i + 30])], ["u", "v"]) for i in range(0, len(u), 30)))
    assert len(parts) > 5 and all(len(set(p.column(0).to_pylist())) == p.num_rows for p in parts)
    left = np.concatenate([np.stack([p.column(0).to_numpy(), p.column(1).to_numpy()]) for p in parts], 1)
    assert all((x == y).all() for x, y in zip(graph.roots_of(*left), graph.roots_of(u, v), strict=True))


def test_statistics_and_catalogue(spark):
    m = mask((4, 4), [(0, 0), (0, 1), (3, 3), (1, 2)])
    r = q.from_numpy(spark, m)
    s = q.water_stats(r, 1000.0)
    assert (s["num_water_bodies"], s["total_area"], s["largest_body"], s["coverage_percent"]) == (3, 4.0, 2.0, 25.0)
    assert s["mean_body_size"] == pytest.approx(4 / 3) and q.water_stats(r, 1000.0, compat=True)["mean_body_size"] == 1.0
    cells, bodies = q.get_water_bodies(r, 1000.0, min_area=2e6)
    assert sorted(map(tuple, cells.collect())) == [(0, 0, 1), (0, 1, 1)] and [tuple(x) for x in bodies.collect()] == [(1, 2.0)]
    shapes = q.water_stats(r, 1000.0, calculate_shapes=True)["shape_metrics"]
    assert shapes["body_metrics"].count() == 3
    with pytest.raises(TypeError):
        q.water_stats(m)


def test_change(spark):
    one = np.array([[1, 1, 0, 0], [1, 1, 0, 0], [0, 0, 0, 1], [0, 0, 0, 1]], bool)
    two = np.array([[1, 1, 1, 0], [1, 0, 0, 0], [0, 0, 0, 1], [0, 0, 1, 1]], bool)
    a, b = q.from_numpy(spark, one), q.from_numpy(spark, two)
    got = q.water_change(a, b, 1000.0)
    assert (got["gained_area"], got["lost_area"], got["change_percent"]) == (2.0, 1.0, pytest.approx(100 / 6))
    change = got["change_mask"].to_numpy()
    assert sorted(zip(*np.nonzero(change == 1), strict=True)) == [(0, 2), (3, 2)] and change[1, 1] == -1
    back = q.water_change(b, a, 1000.0)
    assert (back["gained_area"], back["lost_area"]) == (1.0, 2.0)
    none = q.from_numpy(spark, np.zeros((4, 4), bool))
    assert q.water_change(none, b)["change_percent"] == float("inf") and q.water_change(none, none)["change_percent"] == 0
    assert q.water_change(a, b, 1000.0, min_change_area=1.0)["gained_area"] == 2.0
    assert q.water_change(a, b, 1000.0, min_change_area=1.0, compat=True)["gained_area"] == 0.0
    with pytest.raises(ValueError):
        q.water_change(a, q.from_numpy(spark, np.zeros((2, 2), bool)))


def test_stencils_equal_numpy(spark):
    x = np.random.default_rng(2).random((6, 9))
    r = q.from_numpy(spark, x)
    for axis in (0, 1):
        np.testing.assert_allclose(gradient(r, axis).to_numpy(), np.gradient(x, axis=axis), atol=1e-12)
    for size in (2, 3, 5):
        b = size // 2
        p = np.pad(x, ((b, size - b - 1), (b, size - b - 1)), mode="symmetric")
        windows = np.lib.stride_tricks.sliding_window_view(p, (size, size))
        got = box(r.df, ["value"], 6, 9, size).toPandas().sort_values(["row", "col"])
        np.testing.assert_allclose(got["value_mean"].to_numpy().reshape(6, 9), windows.mean((2, 3)), atol=1e-9)
        np.testing.assert_allclose(got["value_variance"].to_numpy().reshape(6, 9), windows.var((2, 3)), atol=1e-9)


def test_opening_equals_repeated_rounds(spark):
    m = np.random.default_rng(3).random((12, 12)) < 0.85

    def step(a, all_):
        w = np.lib.stride_tricks.sliding_window_view(np.pad(a, 1), (3, 3))
        return w.all((2, 3)) if all_ else w.any((2, 3))

    for n in (1, 2):
        ref = m
        for all_ in (True, False):
            for _ in range(n):
                ref = step(ref, all_)
        got = opening(q.from_numpy(spark, m), n).to_numpy() > 0
        assert (got == ref).all()
