"""The same results as lacustra.plans.queries in DuckDB SQL, under the same names."""

from __future__ import annotations

from lacustra.plans.tables import LINE_BANDS, ORDER_WIDTH, SECOND


def _r(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0"


def _clean(over: str, under: str) -> str:
    return f"(CASE WHEN ({under}) = 0 THEN 0.0 ELSE greatest(-1.0, least(1.0, ({over}) / ({under}))) END)"


def _nd(a: str, b: str) -> str:
    return _clean(f"{a} - {b}", f"{a} + {b}")


def _formulas(scale: float) -> dict[str, str]:
    b = {k: f"({c} / {scale}::DOUBLE)" for k, c in LINE_BANDS.items()}
    return {
        "ndvi": _nd(b["nir"], b["red"]),
        "evi": _clean(f"2.5::DOUBLE * ({b['nir']} - {b['red']})", f"{b['nir']} + 6.0::DOUBLE * {b['red']} - 7.5::DOUBLE * {b['blue']} + 1.0::DOUBLE"),
        "savi": f"(CASE WHEN ({b['nir']} + {b['red']} + 0.5::DOUBLE) = 0 THEN 0.0 ELSE greatest(-1.0, least(1.0, ({b['nir']} - {b['red']}) / ({b['nir']} + {b['red']} + 0.5::DOUBLE) * 1.5::DOUBLE)) END)",
        "ndwi": _nd(b["nir"], b["green"]),
        "ndbi": _nd(b["swir1"], b["nir"]),
        "nbr": _nd(b["nir"], b["swir2"]),
        "ndmi": _nd(b["nir"], b["swir1"]),
    }


_CELLS = "e AS (SELECT vec_id::INTEGER AS row, unnest(range(len(embedding)))::INTEGER AS col, unnest(embedding)::DOUBLE AS v FROM embeddings)"
_REDUCTIONS = ", ".join(f"{_r(f'{f}(v)')} AS {k}" for k, f in {"sum": "sum", "mean": "avg", "std": "stddev_pop", "min": "min", "max": "max"}.items())
_MASKS = f"""n AS (SELECT user_id::INTEGER AS row, hour(ts)::INTEGER AS col, count(*) FILTER (WHERE ts < TIMESTAMP '{SECOND}') AS n1, count(*) FILTER (WHERE ts >= TIMESTAMP '{SECOND}') AS n2 FROM events GROUP BY ALL),
    f AS (SELECT r.row, c.col FROM (SELECT unnest(range((SELECT max(user_id) + 1 FROM events)))::INTEGER AS row) r, (SELECT unnest(range(24))::INTEGER AS col) c),
    m AS (SELECT f.row, f.col, coalesce(n1, 0) >= 2 AS m1, coalesce(n2, 0) >= 2 AS m2 FROM f LEFT JOIN n ON n.row = f.row AND n.col = f.col)"""
_BODIES = f"""{_MASKS}, p AS (SELECT row, col, row * 24 + col AS k FROM m WHERE m1),
    links AS (SELECT a.k AS x, b.k AS y FROM p a JOIN p b ON abs(a.row - b.row) + abs(a.col - b.col) = 1),
    reach(k, l) AS (SELECT k, k FROM p UNION SELECT links.y, reach.l FROM reach JOIN links ON links.x = reach.k WHERE reach.l < links.y),
    root AS (SELECT k, min(l) AS l FROM reach GROUP BY k),
    body AS (SELECT p.row, p.col, dense_rank() OVER (ORDER BY root.l)::INTEGER AS body_id FROM p JOIN root USING (k))"""
_SHAPES = """h AS (SELECT max(row) + 1 AS h FROM m),
    dr AS (SELECT body_id, row - 1 AS row, col, CASE WHEN row - 1 = 0 THEN 1.0 ELSE 0.5 END AS gy, 0.0 AS gx FROM body WHERE row >= 1
        UNION ALL SELECT body_id, row + 1, col, -CASE WHEN row + 1 = h - 1 THEN 1.0 ELSE 0.5 END, 0.0 FROM body, h WHERE row <= h - 2
        UNION ALL SELECT body_id, row, col, -1.0, 0.0 FROM body WHERE row = 0 UNION ALL SELECT body_id, row, col, 1.0, 0.0 FROM body, h WHERE row = h - 1
        UNION ALL SELECT body_id, row, col - 1, 0.0, CASE WHEN col - 1 = 0 THEN 1.0 ELSE 0.5 END FROM body WHERE col >= 1
        UNION ALL SELECT body_id, row, col + 1, 0.0, -CASE WHEN col + 1 = 23 THEN 1.0 ELSE 0.5 END FROM body WHERE col <= 22
        UNION ALL SELECT body_id, row, col, 0.0, -1.0 FROM body WHERE col = 0 UNION ALL SELECT body_id, row, col, 0.0, 1.0 FROM body WHERE col = 23),
    g AS (SELECT body_id, row, col, sum(gx)::DOUBLE AS gx, sum(gy)::DOUBLE AS gy FROM dr GROUP BY ALL),
    per AS (SELECT body_id, sum(sqrt(gx * gx + gy * gy)) AS perimeter FROM g GROUP BY body_id),
    mom AS (SELECT body_id, count(*) AS pixels, var_pop(col::DOUBLE) AS xx, var_pop(row::DOUBLE) AS yy, covar_pop(col::DOUBLE, row::DOUBLE) AS xy FROM body GROUP BY body_id),
    mom2 AS (SELECT body_id, pixels, CASE WHEN abs(xx - yy) < 1e-9 THEN yy ELSE xx END AS xx, yy, CASE WHEN abs(xy) < 1e-9 THEN 0.0 ELSE xy END AS xy FROM mom),
    eig AS (SELECT *, (xx + yy) / 2 AS mid, sqrt(((xx - yy) / 2) ** 2 + xy * xy) AS spread FROM mom2),
    shape AS (SELECT body_id, pixels, perimeter, CASE WHEN perimeter > 0 THEN 4 * pi() * pixels / (perimeter * perimeter) ELSE 0.0 END AS compactness,
        CASE WHEN mid - spread > 1e-12 THEN sqrt((mid + spread) / (mid - spread)) ELSE 1.0 END AS elongation, degrees(0.5 * atan2(2 * xy, xx - yy)) AS orientation FROM eig JOIN per USING (body_id))"""
_ORDERS = f"o AS (SELECT (o_orderkey // {ORDER_WIDTH})::INTEGER AS row, (o_orderkey % {ORDER_WIDTH})::INTEGER AS col, o_totalprice::DOUBLE AS v FROM orders), s AS (SELECT count(*) // {ORDER_WIDTH} AS h, {ORDER_WIDTH} AS w FROM orders)"


#: Kernels over the distance x in target cells (in source cells where the raster grows).
_KERNELS = {
    "cubic": "CASE WHEN x < 1 THEN (1.5 * x - 2.5) * x * x + 1 WHEN x < 2 THEN ((2.5 - 0.5 * x) * x - 4) * x + 2 ELSE 0 END",
    "cubic_spline": "CASE WHEN x < 1 THEN 2.0 / 3 - x * x + x * x * x / 2 WHEN x < 2 THEN (2 - x) ** 3 / 6 ELSE 0 END",
    "lanczos": "CASE WHEN x < 1e-9 THEN 1 WHEN x < 3 THEN 3 * sin(pi() * x) * sin(pi() * x / 3) / (pi() * pi() * x * x) ELSE 0 END",
    "gauss": "CASE WHEN x <= 1.5 THEN exp(-2 * x * x) ELSE 0 END",
}


def _weights(axis: str, size: str, out: int, kind: str) -> str:
    """(i, j, w) of one axis: triangles that widen when shrinking, or shares of area."""
    base = f"SELECT i, j, {size}::DOUBLE / {out} AS step FROM s, (SELECT unnest(range({out}))::INTEGER AS i), (SELECT unnest(range((SELECT {size} FROM s)))::INTEGER AS j)"
    raw = {
        "nearest": f"SELECT i, j, 1.0 AS w FROM ({base}) WHERE j = least((SELECT {size} FROM s) - 1, floor((i + 0.5) * step))",
        "bilinear": f"SELECT i, j, greatest(0.0, 1 - abs((j - ((i + 0.5) * step - 0.5)) / greatest(1.0, step))) AS w FROM ({base})",
        "average": f"SELECT i, j, least(j + 1, (i + 1) * step) - greatest(j, i * step) AS w FROM ({base})",
        **{k: f"SELECT i, j, {w} AS w FROM (SELECT i, j, abs((j - ((i + 0.5) * step - 0.5)) / greatest(1.0, step)) AS x FROM ({base}))" for k, w in _KERNELS.items()},
    }[kind]
    kept = "w > 1e-12" if kind not in _KERNELS else "abs(w) > 1e-12"
    return f"{axis} AS (SELECT i, j, w / sum(w) OVER (PARTITION BY i) AS w FROM ({raw}) WHERE {kept})"


def _resampled(h: int, w: int, kind: str, digits: int) -> str:
    return f"""WITH {_ORDERS}, {_weights("wr", "h", h, kind)}, {_weights("wc", "w", w, kind)}
        SELECT a.i::INTEGER AS row, b.i::INTEGER AS col, {_r("sum(o.v * a.w * b.w)", digits)} AS value FROM o JOIN wr a ON a.j = o.row JOIN wc b ON b.j = o.col GROUP BY a.i, b.i"""


def _areas(h: int, w: int) -> str:
    """(method, row, col, value) by the aggregates over the cells that a target cell covers."""
    kinds = {"sum": f"sum(t * ww) * any_value(area) / {h * w}", "rms": "sqrt(sum(t * t * ww))", "max": "max(t)", "min": "min(t)", "med": "quantile_cont(t, 0.5)", "q1": "quantile_cont(t, 0.25)", "q3": "quantile_cont(t, 0.75)"}
    each = " UNION ALL ".join(f"SELECT '{k}' AS method, i::INTEGER AS row, k::INTEGER AS col, {_r(x)} AS value FROM c GROUP BY i, k" for k, x in kinds.items())
    return f"""WITH {_ORDERS}, {_weights("wr", "h", h, "average")}, {_weights("wc", "w", w, "average")},
        c AS (SELECT a.i AS i, b.i AS k, floor(o.v / 10000) AS t, a.w * b.w AS ww, s.h * s.w AS area FROM o JOIN wr a ON a.j = o.row JOIN wc b ON b.j = o.col, s),
        n AS (SELECT i, k, t, row_number() OVER (PARTITION BY i, k ORDER BY count(*) DESC, t) AS place FROM c GROUP BY i, k, t)
        {each} UNION ALL SELECT 'mode', i::INTEGER, k::INTEGER, {_r("t")} FROM n WHERE place = 1"""


def _histogram(source: str, bins: int) -> str:
    """SELECT (bin, bin_start, bin_end, n, height) of the column v of a table."""
    return f"""SELECT b.bin::INTEGER AS bin, b.lo AS bin_start, b.hi AS bin_end, count(t.v) AS n, count(t.v) / ((SELECT count(*) FROM {source}) * any_value(b.width)) AS height FROM
        (SELECT bin, width, lo + bin * width AS lo, CASE WHEN bin = {bins - 1} THEN hi ELSE lo + (bin + 1) * width END AS hi FROM
            (SELECT min(v) AS lo, max(v) AS hi, (max(v) - min(v)) / {bins} AS width FROM {source}), (SELECT unnest(range({bins})) AS bin)) b
        LEFT JOIN {source} t ON t.v >= b.lo AND (t.v < b.hi OR b.bin = {bins - 1} AND t.v <= b.hi) GROUP BY b.bin, b.lo, b.hi"""


def _histogram_rounded(source: str, bins: int) -> str:
    return f"SELECT bin, {_r('bin_start')} AS bin_start, {_r('bin_end')} AS bin_end, n, {_r('height')} AS height FROM ({_histogram(source, bins)})"


def _stretched(bands: dict[str, str], scale: float, gamma: float) -> str:
    return ", ".join(f"power(greatest(0.0, least(1.0, ({c} / {scale}::DOUBLE) / (SELECT quantile_cont({c} / {scale}::DOUBLE, 0.98) FROM lineitem))), {1 / gamma}) AS {k}" for k, c in bands.items())


def _gradient(axis: str, by: str) -> str:
    w = f"OVER (PARTITION BY {by} ORDER BY {axis})"
    return f"CASE WHEN lag(v) {w} IS NULL THEN lead(v) {w} - v WHEN lead(v) {w} IS NULL THEN v - lag(v) {w} ELSE (lead(v) {w} - lag(v) {w}) / 2 END"


_K = "l_orderkey, l_linenumber"
_P = "l_extendedprice"
_WHOLE = f"(({_P} - (SELECT avg({_P}) FROM lineitem)))"
_IDX100, _IDX1 = _formulas(100.0), _formulas(1.0)
_ALL = f"WITH {_CELLS} SELECT row, col, {_r('v')} AS value FROM e"

ORACLE_SQL: dict[str, str] = {
    "s1_read_geotiff": _ALL,
    "s2_write_pixels": _ALL,
    "v1_v2_v3_validation": """SELECT * FROM (VALUES ('array', 'None'), ('array of NaN', 'ValueError'), ('array without cells', 'ValueError'), ('no array', 'TypeError'), ('bands', 'None'), ('no bands', 'ValueError'),
        ('bands of two shapes', 'ValueError'), ('a band of NaN', 'ValueError'), ('index of two shapes', 'ValueError'), ('index of a number', 'TypeError'), ('index with a bad factor', 'ValueError'), ('index', '(1000, 8)')) t(checked, outcome)""",
    "v4_pixel_size": "SELECT * FROM (VALUES ('30', '900.0'), ('10 x 20', '200.0'), ('0', 'ValueError'), ('-1', 'ValueError'), ('three', 'ValueError'), ('text', 'TypeError')) t(size, outcome)",
    "s3_s4_model_round_trip": "SELECT count(*) AS n, count(*) AS same, 'rf' AS kind FROM embeddings",
    "a1_a5_reductions": f"WITH {_CELLS} SELECT {_REDUCTIONS} FROM e",
    "a1_a5_reductions_axis0": f"WITH {_CELLS} SELECT col, {_REDUCTIONS} FROM e GROUP BY col",
    "a1_a5_reductions_axis1": f"WITH {_CELLS} SELECT row, {_REDUCTIONS} FROM e GROUP BY row",
    "a6_median": f"WITH {_CELLS} SELECT col, {_r('median(v)')} AS median FROM e GROUP BY col",
    "a7_percentile": "SELECT " + ", ".join(f"{_r(f'quantile_cont({_P}, {q / 100})')} AS p{q}" for q in (0, 2, 25, 50, 75, 98, 100)) + " FROM lineitem",
    "a8_count_nonzero": "SELECT count(*) FILTER (WHERE l_discount <> 0) AS count_nonzero FROM lineitem",
    "a9_unique": "SELECT l_quantity AS value, count(*) AS count FROM lineitem GROUP BY l_quantity",
    "a10_stats": "SELECT "
    + ", ".join(
        f"{_r(x, 4)} AS {k}"
        for k, x in {
            "min": f"min({_P})", "max": f"max({_P})", "mean": f"avg({_P})", "std": f"stddev_pop({_P})", "median": f"median({_P})", "range": f"max({_P}) - min({_P})", "variance": f"var_pop({_P})",
            "skewness": f"avg({_WHOLE} ** 3) / avg({_WHOLE} ** 2) ** 1.5", "kurtosis": f"avg({_WHOLE} ** 4) / avg({_WHOLE} ** 2) ** 2 - 3",
            "valid_percent": "100.0::DOUBLE", "nan_percent": "0.0::DOUBLE", "zeros_percent": f"100.0::DOUBLE * count(*) FILTER (WHERE {_P} = 0) / count(*)", "inf_percent": "0.0::DOUBLE",
            **{f"p{q}": f"quantile_cont({_P}, {q / 100})" for q in (0, 25, 50, 75, 100)},
            "reflectance_min": f"min({_P} / 1000)", "reflectance_max": f"max({_P} / 1000)", "reflectance_mean": f"avg({_P} / 1000)", "reflectance_std": f"stddev_pop({_P} / 1000)", "reflectance_median": f"median({_P} / 1000)",
            **{f"reflectance_p{q}": f"quantile_cont({_P} / 1000, {q / 100})" for q in (0, 25, 50, 75, 100)},
        }.items()
    )
    + f", count(*) AS size, count(*) FILTER (WHERE {_P} <> 0) AS non_zero, count(*) AS valid, 0::BIGINT AS nan, count(*) FILTER (WHERE {_P} = 0) AS zeros, 0::BIGINT AS inf FROM lineitem",
    "i0_normalized_difference": f"SELECT {_K}, {_r(_nd('l_discount', 'l_tax'))} AS nd FROM lineitem",
    **{f"i{i}_{n}": f"SELECT {_K}, {_r(_IDX100[n])} AS {n} FROM lineitem" for i, n in enumerate(("ndvi", "evi", "savi", "ndwi", "ndbi", "nbr", "ndmi"), 1)},
    "i8_calculate_indices": f"SELECT {_K}, " + ", ".join(f"{_r(x)} AS {n}" for n, x in _IDX1.items()) + " FROM lineitem",
    "i9_reflectance_scale": f"SELECT {_K}, {_r(f'{_P} / 10000.0::DOUBLE')} AS reflectance FROM lineitem",
    "p1_p6_masks": f"""SELECT {_r("100.0::DOUBLE * count(*) FILTER (WHERE l_discount > 0.05::DOUBLE) / count(*)")} AS coverage, count(*) FILTER (WHERE NOT l_discount > 0.05::DOUBLE AND l_tax > 0.04::DOUBLE) AS only_b,
        count(*) FILTER (WHERE l_discount > 0.05::DOUBLE AND NOT l_tax > 0.04::DOUBLE) AS only_a, count(*) FILTER (WHERE l_discount > 0.05::DOUBLE AND l_tax > 0.04::DOUBLE) AS in_both,
        count(*) FILTER (WHERE isfinite({_P})) AS finite, count(*) FILTER (WHERE abs(l_discount - l_tax) > 0.02::DOUBLE) AS apart FROM lineitem""",
    "r1_resample_nearest": _resampled(60, 70, "nearest", 6),
    "r1_resample_bilinear": _resampled(60, 150, "bilinear", 8),
    "r1_resample_average": _resampled(30, 40, "average", 8),
    "r1_resample_kernels": " UNION ALL ".join(f"SELECT '{k}' AS method, row, col, value FROM ({_resampled(40, 130, k, 3)})" for k in _KERNELS),
    "r1_resample_areas": _areas(30, 40),
    "r1_resample_whole_numbers": f"""WITH {_ORDERS}, m AS (SELECT row // 2 AS row, col // 2 AS col, sum(floor(v / 10000)) AS t FROM o, s WHERE row < h // 2 * 2 GROUP BY ALL)
        SELECT row::INTEGER AS row, col::INTEGER AS col, CASE WHEN t % 4 = 2 THEN 2 * floor((t + 4) / 8) ELSE round(t / 4) END + 0.0 AS value FROM m""",
    "r2_components": f"WITH RECURSIVE {_BODIES} SELECT row, col, body_id FROM body",
    "r3_shape_metrics": f"WITH RECURSIVE {_BODIES}, {_SHAPES} SELECT body_id, pixels, " + ", ".join(f"{_r(c)} AS {c}" for c in ("perimeter", "compactness", "elongation", "orientation")) + " FROM shape",
    "r4_water_stats": f"""WITH RECURSIVE {_BODIES}, z AS (SELECT body_id, count(*) AS n FROM body GROUP BY body_id)
        SELECT {_r("sum(n) * 0.0009::DOUBLE")} AS total_area, {_r("sum(n) * 100.0::DOUBLE / (SELECT count(*) FROM f)")} AS coverage_percent, count(*) AS num_water_bodies,
            {_r("sum(n) / count(*)::DOUBLE * 0.0009::DOUBLE")} AS mean_body_size, {_r("max(n) * 0.0009::DOUBLE")} AS largest_body FROM z""",
    "r5_water_change": f"""WITH {_MASKS}, c AS (SELECT count(*) FILTER (WHERE m1) AS o, count(*) FILTER (WHERE NOT m1 AND m2) AS g, count(*) FILTER (WHERE m1 AND NOT m2) AS l, count(*) FILTER (WHERE m1 AND m2) AS s FROM m)
        SELECT {_r("g * 0.0009::DOUBLE")} AS gained_area, {_r("l * 0.0009::DOUBLE")} AS lost_area, {_r("(g - l) * 0.0009::DOUBLE")} AS net_change, {_r("s * 0.0009::DOUBLE")} AS stable_area,
            {_r("o * 0.0009::DOUBLE")} AS original_area, {_r("CASE WHEN o > 0 THEN (g - l) * 100.0::DOUBLE / o WHEN g > 0 THEN 'inf'::DOUBLE ELSE 0.0 END")} AS change_percent FROM c""",
    "r5_change_mask": f"WITH {_MASKS} SELECT row, col, (NOT m1 AND m2)::INTEGER - (m1 AND NOT m2)::INTEGER AS change, m1 AND m2 AS stable FROM m",
    "r6_opening": f"""WITH {_MASKS}, p AS (SELECT row, col FROM m WHERE m1), d AS (SELECT unnest([-1, 0, 1]) AS d),
        e AS (SELECT p.row, p.col FROM p, d a, d b, p q WHERE q.row = p.row + a.d AND q.col = p.col + b.d GROUP BY p.row, p.col HAVING count(*) = 9)
        SELECT DISTINCT m.row, m.col FROM m JOIN e ON abs(m.row - e.row) <= 1 AND abs(m.col - e.col) <= 1""",
    "r7_water_bodies": f"""WITH RECURSIVE {_BODIES} SELECT (row_number() OVER (ORDER BY body_id))::INTEGER AS body_id, {_r("n * 0.0009::DOUBLE")} AS area FROM (SELECT body_id, count(*) AS n FROM body GROUP BY body_id HAVING count(*) >= 3)""",
    "r8_gradient": f"WITH {_CELLS} SELECT row, col, {_r(_gradient('row', 'col'))} AS gy, {_r(_gradient('col', 'row'))} AS gx FROM e",
    "m1_extract_features": f"""WITH {_CELLS}, z AS (SELECT max(row) AS h FROM e), d AS (SELECT unnest([-1, 0, 1]) AS d),
        q AS (SELECT c.row, c.col, n.v FROM e c, d a, d b, z, e n WHERE n.row = least(greatest(c.row + a.d, 0), h) AND n.col = least(greatest(c.col + b.d, 0), 63))
        SELECT e.row, e.col, {_r("any_value(e.v)")} AS value, {_r("avg(q.v)")} AS mean, {_r("greatest(0.0, avg(q.v * q.v) - avg(q.v) * avg(q.v))")} AS variance FROM q JOIN e ON e.row = q.row AND e.col = q.col GROUP BY e.row, e.col""",
    "m4_detect_changes": f"WITH {_CELLS} SELECT a.row, a.col, abs(b.v - a.v) > 0.2::DOUBLE AS changed FROM e a JOIN e b ON a.row = b.row AND b.col = a.col + 32 WHERE a.col < 32",
    "m5_augment": "SELECT copy::INTEGER AS copy, label, count(*) AS n FROM embeddings, (SELECT unnest([0, 1, 3]) AS copy) GROUP BY ALL",
    "m6a_kmeans": "SELECT (o_orderkey % 3)::INTEGER AS cluster, count(*) AS n FROM orders GROUP BY 1",
    "m6b_dbscan": """WITH RECURSIVE s AS (SELECT day(ts) AS d, floor(value) AS v, count(*) AS w, min(event_id) AS p FROM events GROUP BY ALL),
        near AS (SELECT a.p, b.p AS q, b.w FROM s a JOIN s b ON a.d = b.d AND abs(a.v - b.v) <= 1),
        core AS (SELECT p FROM near GROUP BY p HAVING sum(w) >= 8),
        links AS (SELECT p, q FROM near WHERE p IN (FROM core) AND q IN (FROM core)),
        reach(p, l) AS (SELECT p, p FROM core UNION SELECT links.q, reach.l FROM reach JOIN links ON links.p = reach.p WHERE reach.l < links.q),
        own AS (SELECT p, min(l) AS f FROM reach GROUP BY p),
        settled AS (FROM own UNION ALL SELECT near.p, min(f) FROM near JOIN own ON own.p = near.q WHERE near.p NOT IN (FROM core) GROUP BY near.p),
        named AS (SELECT f, row_number() OVER (ORDER BY f) - 1 AS cluster FROM (SELECT DISTINCT f FROM own))
        SELECT coalesce(cluster, -1) AS cluster, sum(w)::BIGINT AS n FROM s LEFT JOIN settled USING (p) LEFT JOIN named USING (f) GROUP BY 1""",
    "m8_optimize_clustering": "SELECT 4 AS n_clusters, 3 AS tried",
    "m6c_standard_scaler": f"SELECT {_K}, " + ", ".join(f"{_r(f'({c} - (SELECT avg({c}) FROM lineitem)) / (SELECT stddev_pop({c}) FROM lineitem)')} AS {c}" for c in ("l_extendedprice", "l_quantity")) + " FROM lineitem",
    "m7_analyze_clusters": f"""WITH RECURSIVE {_BODIES}, {_SHAPES} SELECT body_id, {_r("pixels * 900.0::DOUBLE")} AS area_m2, {_r("perimeter * 30.0::DOUBLE")} AS perimeter_m,
        {_r("CASE WHEN perimeter > 0 THEN 4 * pi() * pixels / (perimeter * perimeter) ELSE 0.0 END")} AS compactness FROM shape""",
    "g1_plot": f"""WITH {_ORDERS}, k AS (SELECT greatest(1, ceil(greatest(h, w) / 50.0)::INTEGER) AS k FROM s) SELECT (row // k)::INTEGER AS row, (col // k)::INTEGER AS col, {_r("avg(v)", 4)} AS value FROM o, k GROUP BY ALL""",
    "g2_g3_limits": f"WITH {_CELLS} SELECT {_r('min(v)')} AS vmin, {_r('max(v)')} AS vmax, {_r('-max(abs(v))')} AS change_min, {_r('max(abs(v))')} AS change_max FROM e",
    "g4_histogram": f"WITH t AS (SELECT {_P} AS v FROM lineitem) {_histogram_rounded('t', 50)}",
    "g5_distribution_comparison": f"WITH {_CELLS}, a AS (SELECT v FROM e WHERE col < 32), b AS (SELECT v FROM e WHERE col >= 32) SELECT *, 1 AS part FROM ({_histogram_rounded('a', 20)}) UNION ALL SELECT *, 2 AS part FROM ({_histogram_rounded('b', 20)})",
    "g6_plot_rgb": f"SELECT {_K}, {_r('red')} AS red, {_r('green')} AS green, {_r('blue')} AS blue FROM (SELECT {_K}, {_stretched({'red': 'l_quantity', 'green': 'l_extendedprice', 'blue': 'l_discount'}, 100.0, 2.0)} FROM lineitem)",
    "g7_compare_rgb": " UNION ALL ".join(
        f"SELECT {_r('avg(red)')} AS red, {_r('avg(green)')} AS green, {_r('avg(blue)')} AS blue, {i} AS image FROM (SELECT {_stretched(b, 1.0, 1.0)} FROM lineitem)"
        for i, b in enumerate(({"red": "l_quantity", "green": "l_extendedprice", "blue": "l_discount"}, {"red": "l_tax", "green": "l_discount", "blue": "l_quantity"}), 1)
    ),
    "t1_stream_coverage": f"SELECT day(ts)::INTEGER AS day, count(*) AS cells, count(*) FILTER (WHERE value > 50) AS covered, {_r('count(*) FILTER (WHERE value > 50) * 100.0::DOUBLE / count(*)')} AS percent FROM events GROUP BY day(ts)",
}
