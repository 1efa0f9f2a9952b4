"""Exact percentiles by narrowing: the values of brute force, and what one task reads."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import lacustra as q
from lacustra.functions import selection, stats

NAN, INF = float("nan"), float("inf")
QS = (0, 2, 25, 50, 75, 98, 100)
N = 400_000


def most_read(spark, run):
    """The bytes that the largest single task of run's stages reads from a shuffle (stages of one task), and run's result."""
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm

    def stages():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        got = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), None)
        return {s.stageId(): s.shuffleReadBytes() for s in (got.apply(i) for i in range(got.size())) if s.numTasks() == 1}

    before = set(stages())
    result = run()
    return max(v for k, v in stages().items() if k not in before), result


def distinct(spark):
    """A raster of N cells, whose bands a, b and c have N distinct values in no order; and the values."""
    x = (F.col("id") * 7919 % N).cast("double")
    df = spark.range(0, N, 1, 4).select(F.lit(0).alias("row"), F.col("id").cast("int").alias("col"), (x / 7).alias("a"), (x * x).alias("b"), (x - N / 2).alias("c"))
    i = (np.arange(N) * 7919 % N).astype(float)
    return q.Raster(df, 1, N, ("a", "b", "c")), {"a": i / 7, "b": i * i, "c": i - N / 2}


def test_percentile_reads_no_distinct_values(spark):
    r, values = distinct(spark)
    read, got = most_read(spark, lambda: q.percentile(r["a"], list(QS)))
    assert got == pytest.approx(list(np.percentile(values["a"], QS)), rel=1e-12)
    assert read < 2_000_000


def test_plot_rgb_reads_no_distinct_values(spark):
    r, values = distinct(spark)
    read, view = most_read(spark, lambda: q.plot_rgb(r["a"], r["b"], r["c"], percentile=90.0))
    assert read < 2_000_000
    got = view.panels[0].where("col < 100").orderBy("col").select("red", "green", "blue").toPandas().to_numpy()
    np.testing.assert_allclose(got, np.clip(np.stack([values[k][:100] / np.percentile(values[k], 90) for k in "abc"], 1), 0, 1), rtol=1e-12)


@pytest.mark.parametrize("scale", [4.0, -4.0])
def test_stats_read_no_distinct_values(spark, scale):
    r, values = distinct(spark)
    read, got = most_read(spark, lambda: q.stats(r["c"], reflectance_scale=scale))
    assert read < 2_000_000 and got["size"] == N
    c = values["c"]
    assert [got["median"], *got["percentiles"].values()] == pytest.approx(list(np.percentile(c, [50, 0, 25, 50, 75, 100])), rel=1e-12)
    assert list(got["reflectance_stats"]["percentiles"].values()) == pytest.approx(list(np.percentile(c / scale, [0, 25, 50, 75, 100])), rel=1e-12)


def test_compare_rgb_reads_no_distinct_values(spark):
    r, values = distinct(spark)
    read, view = most_read(spark, lambda: q.compare_rgb((r["a"], r["b"], r["c"]), (r["c"], r["a"], r["b"])))
    assert read < 2_000_000
    tops = {k: np.percentile(v, 98) for k, v in values.items()}
    for panel, names in zip(view.panels, ("abc", "cab"), strict=True):
        got = panel.where("col < 100").orderBy("col").select("red", "green", "blue").toPandas().to_numpy()
        np.testing.assert_allclose(got, np.clip(np.stack([values[k][:100] / tops[k] for k in names], 1), 0, 1), rtol=1e-12)


@pytest.fixture
def narrow(monkeypatch):
    monkeypatch.setattr(selection, "LIMIT", 20)
    monkeypatch.setattr(selection, "GROUP_LIMIT", 20)
    monkeypatch.setattr(selection, "STEPS", 8)


def sets():
    r = np.random.default_rng(1)
    return {
        "even": r.random(3000),
        "heavy": np.exp(r.normal(0, 100, 3000)) * r.choice([-1, 1], 3000),
        "few": r.integers(0, 4, 3000).astype(float),
        "one": np.full(3000, 2.5),
        "mostly": np.r_[np.zeros(2900), r.random(100)],
        "infinite": np.r_[[-INF] * 100, r.random(2800), [INF] * 100],
        "neighbours": np.nextafter(1.0, 2.0) * np.r_[[1.0] * 1500, [1 + 2**-52] * 1500],
    }


@pytest.mark.parametrize("name", sets())
def test_rounds_give_what_spark_gives(spark, narrow, name):
    df = spark.createDataFrame([(float(x),) for x in sets()[name]] + [(None,)] * 3, "v double").repartition(3)
    want = df.agg(F.percentile("v", F.array(*[F.lit(p / 100) for p in QS]))).first()[0]
    got = selection.percentiles(df, {"v": F.col("v")}, [p / 100 for p in QS])["v"]
    assert repr([got[p / 100] for p in QS]) == repr(want)


def test_missing_values(spark, narrow):
    df = spark.createDataFrame([(float(x), None, NAN if x == 7 else float(x)) for x in range(100)], "a double, b double, c double")
    columns = {k: F.col(k) for k in "abc"}
    assert selection.percentiles(df, columns, [0.5]) == {"a": {0.5: 49.5}, "b": {0.5: None}, "c": {0.5: 50.0}}
    wins = selection.percentiles(df, columns, [0.5], nan_wins=True)
    assert wins["a"] == {0.5: 49.5} and wins["b"] == {0.5: None} and np.isnan(wins["c"][0.5])
    with pytest.raises(ValueError):
        selection.percentiles(df, columns, [1.5])


def test_groups_of_all_sizes(spark, narrow):
    """Medians by column: groups left to Spark, large ones, one with NaN."""
    r = np.random.default_rng(2)
    sizes = [1, 5, 20, 21, 300, 2000, 50]
    of = [r.random(n) if n != 300 else r.integers(0, 3, n).astype(float) for n in sizes]
    of[6][3] = NAN
    df = spark.createDataFrame([(i, j, float(x)) for j, v in enumerate(of) for i, x in enumerate(v)], "row int, col int, v double").repartition(3)
    got = {x["col"]: (x["median"], x["max"]) for x in stats.reduced(df, "v", ["median", "max"], 0).collect()}
    assert set(got) == set(range(7)) and np.isnan(got[6][0])
    for j in range(6):
        assert got[j] == (pytest.approx(np.median(of[j]), rel=1e-12), of[j].max())


@pytest.mark.parametrize("method, share", [("med", 50), ("q1", 25), ("q3", 75)])
def test_resampled_percentiles_of_large_blocks(spark, monkeypatch, method, share):
    import sys

    monkeypatch.setattr(selection, "GROUP_LIMIT", 20)
    monkeypatch.setattr(sys.modules["lacustra.operators.resample"], "GROUP_LIMIT", 20)
    x = np.random.default_rng(3).random((40, 30))
    got = q.resample(q.from_numpy(spark, x), (2, 3), method).to_numpy()
    want = [[np.percentile(x[20 * i : 20 * i + 20, 10 * j : 10 * j + 10], share) for j in range(3)] for i in range(2)]
    np.testing.assert_allclose(got, want, rtol=1e-12)


def test_values_that_are_not_only_scanned_are_staged(spark):
    from lacustra.storage import repeatable

    plain = spark.range(10).select(F.explode(F.array("id", "id")).alias("v")).where("v > 2")
    assert repeatable(plain) is plain
    for df in (spark.range(10).groupBy("id").count(), spark.range(10).select(F.rand()), plain.join(spark.range(3), F.col("v") == F.col("id"))):
        kept = repeatable(df)
        assert kept is not df and kept.count() == df.count()
