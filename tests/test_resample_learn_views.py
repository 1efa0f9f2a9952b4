import numpy as np
import pytest

import lacustra as q
from lacustra.operators import clustering, views
from lacustra.operators.resample import AREA, KERNELS
from lacustra.sources import tiff
from lacustra.streaming.scenes import with_indices


def test_resample_bilinear_nearest_average(spark):
    r = q.from_numpy(spark, np.array([[1.0, 2], [3, 4]]))
    np.testing.assert_allclose(q.resample(r, (3, 3)).to_numpy(), [[1, 1.5, 2], [2, 2.5, 3], [3, 3.5, 4]])
    np.testing.assert_allclose(q.resample(r, (1, 1), "average").to_numpy(), [[2.5]])
    np.testing.assert_allclose(q.resample(r, (4, 4), "nearest").to_numpy(), np.repeat(np.repeat([[1, 2], [3, 4]], 2, 0), 2, 1))
    assert q.resample(q.from_numpy(spark, np.array([[1, 2], [3, 4]])), (3, 3)).to_numpy()[0, 1] == 2  # integers are rounded


@pytest.mark.parametrize("method", ["nearest", "average", "rms", *KERNELS, *AREA])
def test_resample_keeps_a_constant(spark, method):
    r = q.from_numpy(spark, np.full((5, 4), 7.0))
    np.testing.assert_allclose(q.resample(r, (3, 6), method).to_numpy(), 7.0)


def test_resample_parameters(spark):
    r = q.from_numpy(spark, np.ones((2, 2)))
    for shape in ([3, 3], (3,), (0, 3), (2.0, 3)):
        with pytest.raises(ValueError):
            q.resample(r, shape)
    with pytest.raises(ValueError):
        q.resample(r, (2, 2), "none")


@pytest.mark.parametrize("dtype,compress", [("float64", "deflate"), ("float32", "none"), ("uint16", "deflate"), ("int16", "none"), ("uint8", "deflate")])
def test_geotiff_round_trip(spark, tmp_path, dtype, compress):
    x = np.arange(150 * 3).reshape(150, 3) % 200
    path = f"file://{tmp_path}/a.tif"
    q.write(path, q.from_numpy(spark, x), {"dtype": dtype, "compress": compress, "transform": [30.0, 0, 100.0, 0, -30.0, 200.0]})
    r, meta = q.read(spark, path)
    assert (r.to_numpy() == x).all() and meta["dtype"] == dtype and meta["transform"][:3] == [30.0, 0.0, 100.0]
    assert tiff.metadata((tmp_path / "a.tif").read_bytes())["height"] == 150


def test_read_errors_and_tables(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        q.read(spark, f"file://{tmp_path}/nonexistent.tif")
    (tmp_path / "b.tif").write_bytes(b"not a raster at all")
    with pytest.raises(ValueError):
        q.read(spark, f"file://{tmp_path}/b.tif")
    r = q.from_numpy(spark, {"a": np.ones((2, 3)), "b": np.zeros((2, 3))})
    q.write_table(r, f"file://{tmp_path}/t", {"crs": "EPSG:4326"})
    again, meta = q.read(spark, f"file://{tmp_path}/t")
    assert again.shape == (2, 3) and meta["crs"] == "EPSG:4326" and again["a"].to_numpy().sum() == 6
    with pytest.raises(ValueError):
        q.write(f"file://{tmp_path}/c.tif", q.from_numpy(spark, np.full((2, 2), np.nan)))


def samples(spark, n=400):
    rng = np.random.default_rng(0)
    label = rng.integers(0, 2, n)
    x = rng.normal(label[:, None] * 3.0, 1.0, (n, 2))
    return spark.createDataFrame([(i, 0, [float(a), float(b)], int(k)) for i, ((a, b), k) in enumerate(zip(x, label, strict=True))], "row int, col int, features array<double>, label int")


def test_classifier_round_trip(spark, tmp_path):
    s = samples(spark)
    got = q.train_classifier(s, n_estimators=10, max_depth=4)
    assert got.accuracy > 0.9 and sum(map(sum, got.confusion_matrix)) > 40
    q.save_model(got.model, f"file://{tmp_path}/m", {"a": 1})
    model, meta = q.load_model(spark, f"file://{tmp_path}/m")
    assert meta == {"a": 1} and q.predict_raster(model, s).count() == 400
    with pytest.raises(FileNotFoundError):
        q.load_model(spark, f"file://{tmp_path}/none")
    with pytest.raises(ValueError):
        q.train_classifier(s, "svm")
    with pytest.raises(TypeError):
        q.predict_raster(object(), s)


def test_augment(spark):
    s = samples(spark, 6)
    out = q.augment_training_data(s, 3, shape=(6, 1)).collect()
    assert len(out) == 30 and {r["label"] for r in out} == {r["label"] for r in s.collect()}
    assert q.augment_training_data(s.select("features", "label"), 2).count() == 12


def test_features_and_changes(spark):
    r = q.from_numpy(spark, {"a": np.ones((4, 4)), "b": np.arange(16.0).reshape(4, 4)})
    f = q.extract_features(r).first()["features"]
    assert len(f) == 6 and f[0] == 1 and f[2] == 1 and f[3] == 0
    one, two = q.from_numpy(spark, np.array([[0.0, 1.0, np.nan]])), q.from_numpy(spark, np.array([[0.5, 2.0, 1.0]]))
    assert q.detect_changes_ml(one, two).to_numpy().tolist() == [[0, 1, 0]]


def test_kmeans_and_analysis(spark):
    x = np.zeros((6, 6))
    x[1:3, 1:4] = 5
    r = q.from_numpy(spark, x)
    clusters, meta = q.cluster_water_bodies(r, n_clusters=2, water_index=q.from_numpy(spark, -x))
    assert meta["inertia"] == pytest.approx(0, abs=1e-6) and meta["water_cluster"] in (0, 1)
    got = q.analyze_water_clusters(clusters, meta["water_cluster"])
    assert (got["num_water_bodies"], got["total_area_m2"]) == (1, 6 * 900.0)
    empty = q.analyze_water_clusters(clusters, 9)
    assert empty["num_water_bodies"] == 0 and empty["total_area_m2"] == 0
    best, tried = q.optimize_clustering(r, param_grid={"n_clusters": [2, 3], "random_state": [42]})
    assert len(tried) == 2 and best["n_clusters"] in (2, 3)
    with pytest.raises(ValueError):
        q.cluster_water_bodies(r, "none")


def plain_dbscan(x, eps, least):
    far = ((x[:, None] - x[None]) ** 2).sum(2) <= eps * eps
    core = far.sum(1) >= least
    out, n = np.full(len(x), -1), 0
    for i in range(len(x)):
        if not core[i] or out[i] >= 0:
            continue
        todo = [i]
        while todo:
            j = todo.pop()
            if out[j] < 0:
                out[j] = n
                if core[j]:
                    todo += np.flatnonzero(far[j] & (out < 0)).tolist()
        n += 1
    return out


def test_dbscan_equals_the_plain_way(spark):
    x = np.round(np.random.default_rng(4).random((300, 2)) * 6, 1)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, a double, b double")
    got = {r["id"]: r["cluster"] for r in clustering.dbscan(df, ["a", "b"], 0.25, 4).collect()}
    assert [got[i] for i in range(300)] == plain_dbscan(x, 0.25, 4).tolist()


def test_views(spark):
    r = q.from_numpy(spark, np.array([[1.0, np.nan], [3, -4]]))
    assert q.plot(r, vmin=0, vmax=2).limits == (0, 2) and q.changes(r).limits == (-4, 4) and q.compare(r, r).limits == (-4, 3)
    heights = [x["n"] for x in q.hist(r, bins=7, density=False).panels[0].orderBy("bin").collect()]
    assert heights == np.histogram([1, 3, -4], 7)[0].tolist()
    assert len(q.distribution_comparison(r, q.from_numpy(spark, np.ones((3, 3)))).panels) == 2
    with pytest.raises(TypeError):
        q.plot([[1]])
    with pytest.raises(ValueError):
        q.compare(r, q.from_numpy(spark, np.ones((3, 3))))
    rgb = q.from_numpy(spark, {k: np.arange(9.0).reshape(3, 3) for k in "abc"})
    got = q.plot_rgb(rgb["a"], rgb["b"], rgb["c"], gamma=2.0).panels[0].agg({"red": "max", "blue": "min"}).first()
    assert sorted(got) == [0.0, 1.0] and len(q.compare_rgb((rgb["a"],) * 3, (rgb["b"],) * 3).panels) == 2
    assert views.thinned(q.from_numpy(spark, np.arange(16.0).reshape(4, 4)), cells=2).count() == 4


def test_histogram_equals_numpy_on_edges(spark):
    x = np.round(np.random.default_rng(5).random(500), 2)
    got = q.hist(q.from_numpy(spark, x[None, :]), bins=13, density=True).panels[0].orderBy("bin").toPandas()
    np.testing.assert_allclose(got["height"], np.histogram(x, 13, density=True)[0], atol=1e-9)
    constant = q.hist(q.from_numpy(spark, np.ones((2, 2))), bins=4, density=False).panels[0].orderBy("bin").toPandas()
    assert constant["n"].tolist() == np.histogram(np.ones(4), 4)[0].tolist()


def test_stream_of_scenes(spark, tmp_path):
    spark.createDataFrame([(0.2, 0.4), (0.0, 0.0)], "red double, nir double").write.parquet(f"{tmp_path}/in")
    stream = with_indices(spark.readStream.schema("red double, nir double").parquet(f"{tmp_path}/in"), ["ndvi"])
    stream.writeStream.format("memory").queryName("scenes").trigger(availableNow=True).start().awaitTermination()
    assert sorted(round(r["ndvi"], 6) for r in spark.table("scenes").collect()) == [0.0, 0.333333]


def lzw(data: bytes) -> bytes:
    """A plain LZW writer for TIFF: codes get wider as soon as entry 511, 1023 or 2047 is added."""
    out, held, bits = bytearray(), 0, 0
    table, word, width = {bytes([i]): i for i in range(256)}, b"", 9

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)

    put(256)
    following = 258
    for b in data:
        if word + bytes([b]) in table:
            word += bytes([b])
            continue
        put(table[word])
        table[word + bytes([b])] = following
        following += 1
        width = min(12, max(9, following.bit_length()))
        word = bytes([b])
        if following == 4094:
            put(table[word])
            put(256)
            table, word, following, width = {bytes([i]): i for i in range(256)}, b"", 258, 9
    if word:
        put(table[word])
        following += 1
        width = min(12, max(9, following.bit_length()))
    put(257)
    return bytes(out) + bytes([held << (8 - bits) & 255] if bits else [])


def test_lzw_and_pack_bits():
    rng = np.random.default_rng(3)
    for data in (b"", b"\7\7\7\10\10\7\7\6\6", bytes(rng.integers(0, 4, 9000).astype(np.uint8)), bytes(rng.integers(0, 256, 20_000).astype(np.uint8)), b"a" * 5000):
        assert tiff.unpacked_lzw(lzw(data)) == data
    assert tiff.unpacked_bits(b"\xfe\xaa\x02\x80\x00\x2a\xfd\xaa\x03\x80\x00\x2a\x22\xf7\xaa\x80") == bytes.fromhex("aaaaaa80002aaaaaaaaa80002a22" + "aa" * 10)


@pytest.mark.parametrize("kind", ["<f4", ">f8"])
def test_predicted_floats(kind):
    block = np.random.default_rng(5).normal(size=(4, 7)).astype(kind)
    high_first = block.astype(np.dtype(kind).newbyteorder(">")).view(np.uint8).reshape(4, 7, -1).transpose(0, 2, 1).reshape(4, -1)
    steps = np.diff(high_first, axis=1, prepend=np.uint8(0)).astype(np.uint8)
    assert (tiff.undone(steps.tobytes(), np.dtype(kind), 4, 7, 1, 3)[:, :, 0] == block).all()


@pytest.mark.parametrize("big", [False, True])
def test_header_of_tiff_and_bigtiff(big):
    meta = {"dtype": "int16", "compress": "none", "transform": [30.0, 0.0, 500.0, 0.0, -30.0, 900.0], "crs": "EPSG:32633", "nodata": -9999}
    a, b = np.arange(12, dtype="<i2").reshape(2, 6), np.arange(6, dtype="<i2").reshape(1, 6)
    sizes, data = [24, 12], a.tobytes() + b.tobytes()
    first = len(tiff._head(0, 3, 6, 2, sizes, meta, big))
    content = tiff._head(first, 3, 6, 2, sizes, meta, big) + data
    said = tiff.metadata(content)
    assert (said["crs"], said["nodata"], said["transform"], said["dtype"]) == ("EPSG:32633", -9999.0, meta["transform"], "int16")
    assert [(r, x.tolist()) for r, x in tiff.strips(content)] == [(0, a.tolist()), (2, b.tolist())]


def test_place_and_missing_values_are_kept(spark, tmp_path):
    values = np.arange(200.0).reshape(100, 2)
    values[3, 1] = np.nan
    one, two = f"file://{tmp_path}/one.tif", f"file://{tmp_path}/two.tif"
    q.write(one, q.from_numpy(spark, values), {"crs": "EPSG:4326", "nodata": -1, "transform": [1.0, 0.0, 2.0, 0.0, -1.0, 3.0]})
    raster, meta = q.read(spark, one)
    q.write(two, raster)
    again = q.read(spark, two)[1]
    assert again["crs"] == meta["crs"] == "EPSG:4326" and again["nodata"] == -1 and again["transform"] == meta["transform"] and again["geo"] == meta["geo"]
    assert raster.to_numpy()[3, 1] == -1


def test_any_model_that_predicts(spark):
    class Threshold:
        """Neither of Spark ML nor of another library."""

        def predict(self, x):
            return (x[:, 0] > 2).astype(int)

    r = q.from_numpy(spark, np.arange(6.0).reshape(2, 3))
    said = {(x["row"], x["col"]): x["prediction"] for x in q.predict_raster(Threshold(), q.extract_features(r, 1, indices=["ndvi"]), batch_size=2).collect()}
    assert said == {(i, j): float(3 * i + j > 2) for i in range(2) for j in range(3)}
    with pytest.raises(TypeError):
        q.predict_raster(object(), q.extract_features(r, 1))


def test_histograms_of_lists(spark):
    counts = [x["n"] for x in q.hist([[0, 1], [2, 3]], bins=3, density=False, reflectance_scale=10).panels[0].orderBy("bin").collect()]
    assert counts == [1, 1, 2]
    with pytest.raises(ValueError):
        q.hist([])


def test_report_as_text():
    from lacustra.operators.features import Classified

    c = Classified(None, 0.75, [[2, 0], [1, 1]], [0.0, 1.0], {"0.0": {"precision": 2 / 3, "recall": 1.0, "f1": 0.8, "support": 2}, "1.0": {"precision": 1.0, "recall": 0.5, "f1": 2 / 3, "support": 2}})
    lines = c.report_text().splitlines()
    assert lines[1].split() == ["0.0", "0.67", "1.00", "0.80", "2"] and lines[3].split() == ["accuracy", "0.75", "4"] and lines[4].split() == ["macro", "avg", "0.83", "0.75", "0.73", "4"]


def test_shared_folder(spark):
    from types import SimpleNamespace

    from lacustra import storage

    without = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077", applicationId="a"))
    with pytest.raises(RuntimeError):
        storage.shared_dir(without)
    without.sparkContext.master = "local[2]"
    assert storage.shared_dir(without) == storage.shared_dir(without) and storage.shared_dir(without).startswith("file://")
