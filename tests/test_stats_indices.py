import numpy as np
import pytest

import lacustra as q
from lacustra.functions import indices
from lacustra.raster import pixel_area_m2

NAN = float("nan")


def raster(spark, values):
    return q.from_numpy(spark, np.array(values))


def test_reductions(spark):
    r = raster(spark, [[1, 2, 3], [4, 5, 6]])
    assert (q.min(r), q.max(r), q.mean(r), q.sum(r)) == (1, 6, 3.5, 21)
    assert q.std(r) == pytest.approx(1.70782513)
    assert [tuple(x) for x in q.sum(r, axis=0).orderBy("col").collect()] == [(0, 5.0), (1, 7.0), (2, 9.0)]
    assert [tuple(x) for x in q.mean(r, axis=1).orderBy("row").collect()] == [(0, 2.0), (1, 5.0)]


def test_nan_is_missing_but_not_for_median_and_percentile(spark):
    r = raster(spark, [[1, NAN, 3], [4, 5, 6]])
    assert q.mean(r) == pytest.approx(3.8) and q.std(r) == pytest.approx(1.72046505)
    assert np.isnan(q.median(r)) and np.isnan(q.percentile(r, 50))
    assert q.count_nonzero(r) == 6
    s = q.stats(r, bins=2)
    assert [s["percentiles"][p] for p in ("0", "25", "50", "75", "100")] == [1, 3, 4, 5, 6]
    assert s["skewness"] == pytest.approx(-0.39587034) and s["kurtosis"] == pytest.approx(-1.00547845)
    assert (s["nan"], s["valid"], s["size"], s["non_zero"]) == (1, 5, 6, 5)
    assert [h[2] for h in s["histogram"]] == [2, 3]


def test_all_nan_and_empty_are_refused(spark):
    with pytest.raises(ValueError):
        q.mean(raster(spark, [[NAN, NAN]]))
    with pytest.raises(ValueError):
        q.validate_array(q.Raster(spark.createDataFrame([], "row int, col int, value double"), 0, 0))
    with pytest.raises(TypeError):
        q.validate_array([[1]])
    with pytest.raises(ValueError):
        q.validate_bands()
    with pytest.raises(ValueError):
        q.validate_bands(raster(spark, [[1, 2]]), raster(spark, [[1, 2, 3]]))


def test_percentile_unique_and_constant(spark):
    r = raster(spark, [[1, 2], [3, 10]])
    assert q.percentile(r, [0, 25, 50, 75, 100]) == [1, 1.75, 2.5, 4.75, 10]
    u = q.unique(raster(spark, [[2, NAN], [2, NAN]]), return_counts=True).collect()
    assert [x["count"] for x in u] == [2, 2] and np.isnan(u[1]["value"])
    assert q.std(raster(spark, [[0, 0], [0, 0]])) == 0


LOW, NIR, BLUE = [[0.1, 0.2], [0.3, 0.4]], [[0.2, 0.3], [0.4, 0.5]], [[0.05, 0.15], [0.25, 0.35]]


def test_index_values(spark):
    r = q.from_numpy(spark, {"red": np.array(LOW), "nir": np.array(NIR), "blue": np.array(BLUE)})
    near = lambda x, y: np.testing.assert_allclose(x.to_numpy(), y, atol=1e-6)
    near(q.ndvi(r["nir"], r["red"]), [[0.33333333, 0.2], [0.14285714, 0.11111111]])
    near(q.ndwi(r["red"], r["nir"]), [[0.33333333, 0.2], [0.14285714, 0.11111111]])
    near(q.ndwi(r["red"], r["nir"], convention="green_first"), [[-0.33333333, -0.2], [-0.14285714, -0.11111111]])
    near(q.evi(r["red"], r["nir"], r["blue"]), [[0.1754386, 0.18181818], [0.18867925, 0.19607843]])
    near(q.savi(r["nir"], r["red"]), [[0.1875, 0.15], [0.125, 0.10714286]])
    near(q.savi(r["nir"], r["red"], L=1.0), [[0.15384615, 0.13333333], [0.11764706, 0.10526316]])


def test_index_of_bands_in_different_tables_and_zero_division(spark):
    a, b = raster(spark, [[0, 0], [0.3, NAN]]), raster(spark, [[0, 0], [0.4, 0.5]])
    np.testing.assert_allclose(q.ndvi(b, a).to_numpy(), [[0, 0], [0.14285714, 0]], atol=1e-6)
    np.testing.assert_allclose(q.ndvi(raster(spark, [[-0.1, 0.2], [0.3, -0.4]]), raster(spark, [[0.2, -0.3], [0.4, 0.5]])).to_numpy(), [[-1, -1], [-0.14285714, -1]], atol=1e-6)
    with pytest.raises(ValueError):
        q.ndvi(a, raster(spark, [[1, 2, 3]]))


def test_unsigned_bands_do_not_wrap(spark):
    g, n = (q.from_numpy(spark, np.array([[v]], np.uint16)) for v in (100, 40))
    assert q.ndbi(n, g).to_numpy()[0, 0] == pytest.approx(-60 / 140)


def test_index_parameters(spark):
    r = raster(spark, [[1.0]])
    with pytest.raises(TypeError):
        q.savi(r, r, L="x")
    with pytest.raises(ValueError):
        q.savi(r, r, L=2)
    with pytest.raises(ValueError):
        q.evi(r, r, r, G=0)
    with pytest.raises(ValueError):
        q.calculate_indices({"nir": r}, ["nothing"])
    with pytest.raises(ValueError, match="red"):
        q.calculate_indices({"nir": r}, ["ndvi"])
    got = q.calculate_indices({"nir": r, "red": r}, ["ndvi", "savi"])
    assert set(got) == {"ndvi", "savi"} and got["ndvi"].df is got["savi"].df


def test_indices_are_one_projection(spark):
    wide = spark.createDataFrame([(0, 0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0)], "row int, col int, blue double, green double, red double, nir double, swir1 double, swir2 double")
    r = q.Raster(wide, 1, 1)
    plan = q.calculate_indices({b: r[b] for b in ("blue", "green", "red", "nir", "swir1", "swir2")}, list(indices.REGISTRY))["ndvi"].df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_pixel_size():
    assert pixel_area_m2(30) == 900 and pixel_area_m2((10, 20)) == 200
    for bad, error in ((-1, ValueError), ((1, -1), ValueError), ([30, 30], TypeError), ("x", TypeError)):
        with pytest.raises(error):
            pixel_area_m2(bad)
