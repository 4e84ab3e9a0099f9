import numpy as np
import pytest
from pyspark.sql import functions as F

from soundings.operators import kernels as k
from soundings.sources import son, tables

RNG = np.random.default_rng(3)


def test_savgol_keeps_cubics():
    x = np.arange(120.0)
    y = 2 + 0.1 * x - 0.01 * x**2 + 1e-4 * x**3
    assert np.allclose(k.savgol(y), y)
    with pytest.raises(ValueError):
        k.savgol(y[:50])


def test_spline_keeps_cubics_and_knots():
    x = np.sort(RNG.random(12)) * 10
    y = x**3 - 4 * x**2 + x
    at = np.linspace(x[0], x[-1], 50)
    assert np.allclose(k.spline(x, y, at), at**3 - 4 * at**2 + at)
    assert np.allclose(k.spline(x, np.sin(x), x), np.sin(x))
    for n in (2, 3, 4):
        assert np.allclose(k.spline(x[:n], y[:n], x[:n]), y[:n])


def test_label_regions():
    m = np.array([[1, 0, 0, 1], [0, 1, 0, 1], [0, 0, 0, 0], [1, 1, 0, 1]], bool)
    assert k.label(m)[1] == 4 and k.label(m, eight=False)[1] == 5
    assert k.without_small(m, 2).sum() == 6
    assert k.edge_region(m).sum() == 3
    spiral = RNG.random((40, 40)) > 0.4
    lab, n = k.label(spiral)
    assert set(np.unique(lab)) == set(range(n + 1)) - (set() if (~spiral).any() else {0})


def test_sieve_gives_small_regions_away():
    a = np.ones((6, 6), int)
    a[2, 2] = 2
    assert (k.sieve(a, 3) == 1).all()


def test_erode():
    a = np.ones((5, 5), int)
    assert k.erode(a).sum() == 9


def test_jumps():
    y = np.array([5.0, 5, 50, 5, 5])
    assert np.isnan(k.drop_jumps(y)[2]) and np.isfinite(k.drop_jumps(y)[[0, 1, 3, 4]]).all()


def test_jumps_of_any_length():
    y = np.full(400, 2.4)
    y[100:220] = 9.3  # 120 pings: more than any cap of 64 rounds
    assert not (k.drop_jumps(y, 4.0) > 5).any() and np.isfinite(k.drop_jumps(y, 4.0)[:100]).all()


def test_jumps_equal_the_rule_round_by_round():
    for n in (0, 1, 2, 3, 40, 41, 300):
        y = np.cumsum(RNG.normal(0, 0.3, n)) + 20
        for _ in range(n // 20):
            i = RNG.integers(n)
            y[i : i + RNG.integers(1, 30)] += RNG.choice([-9.0, 9.0, 14.0])
        y[RNG.random(n) < 0.05] = np.nan
        want = y.copy()
        while True:
            at = np.flatnonzero(np.isfinite(want))
            d = np.abs(np.diff(want[at]))
            bad = d > max(4.0, 6 * np.median(np.abs(d - np.median(d)))) if len(d) else d > 0
            if not bad.any():
                break
            want[at[1:][bad]] = np.nan
        assert np.array_equal(k.drop_jumps(y, 4.0, spikes=False), want, equal_nan=True)


def test_resize_and_gaussian():
    a = RNG.random((7, 9))
    assert np.allclose(k.resize(a, a.shape), a)
    assert np.allclose(k.gaussian(np.ones((9, 9)), 1.0), 1)


def test_otsu():
    assert 0.24 < k.otsu(np.concatenate([RNG.normal(0.2, 0.02, 500), RNG.normal(0.8, 0.02, 500)])) < 0.7


def test_clahe_range():
    out = k.clahe(RNG.random((64, 48)))
    assert out.shape == (64, 48) and 0 <= out.min() and out.max() <= 1


def test_strip_warp_of_a_rectangle():
    v = np.tile(np.arange(11.0)[:, None], (1, 6))
    x = np.arange(6.0) * 2
    g, left, top = k.strip_warp(v, x, np.zeros(6), x, np.full(6, 10.0), 1.0)
    assert np.isfinite(g).all() and left == 0 and top == 10
    assert np.allclose(g[:, 0], np.arange(11)[::-1])


def test_bed_rows():
    image = np.full((60, 40), 5.0)
    image[30:] = 100
    assert np.abs(k.bed_rows(image, np.full(40, 28)) - 30).max() <= 1


@pytest.mark.parametrize("layout", [67, 72, 152])
def test_son_round_trip(layout):
    pings = [son.encode_ping(layout, bytes(range(n)), record_num=i, time_ms=1000 * i, heading_dd=905, speed_cm=123, depth_cm=456, beam_no=2, volt=10, f=455000) for i, n in enumerate((5, 0, 64))]
    data = b"".join(pings)
    got = list(son.headers(data))
    assert [g[0] for g in got] == [0, 1, 2] and [g[10] for g in got] == [5, 0, 64]
    assert got[0][4:8] == (90.5, 1.23, 4.56, "ss_port") and got[2][12] == layout
    i, o, n = got[2][11], got[2][12], got[2][10]
    assert list(son.decode(data[i + o : i + o + n])) == list(range(64))
    assert list(son.decode(b"\x01\x02\x03\x04", 2, flip=True)) == [772, 258]


def test_son_source(spark, tmp_path):
    path = tmp_path / "B002.SON"
    path.write_bytes(b"".join(son.encode_ping(72, bytes([i] * 8), record_num=i, beam_no=3) for i in range(20)))
    df = son.read(spark, str(path))
    assert df.count() == 20
    s = son.samples(spark, str(path), df).orderBy("record_num").collect()
    assert s[7]["samples"] == [7.0] * 8
    spark.dataSource.register(son.SonSource)
    assert spark.read.format("son").load(str(path)).where("beam = 'ss_star'").count() == 20


def test_delaunay_circles_are_empty():
    xy = sorted({(int(a), int(b)) for a, b in RNG.integers(0, 25, (120, 2))})
    m = k.Delaunay([a for a, _ in xy], [b for _, b in xy])
    whole = {tuple(sorted((u, v, w))) for (u, v), w in m.to.items() if min(u, v, w) >= 0}
    assert not any(m._near(u, v, w, *p) for (u, v), w in m.to.items() if min(u, v, w) >= 0 for p in xy)
    hull = sum(1 for (u, v), w in m.to.items() if w < 0 and min(u, v) >= 0)
    assert len(whole) == 2 * len(xy) - 2 - hull  # Euler: the triangles leave no part of the hull out


def test_fill_between_is_linear():
    r, c = np.indices((60, 70))
    full = 3.0 + 2 * r + 0.5 * c
    a = np.where(RNG.random(full.shape) < 0.02, full, np.nan)
    a[[0, 0, -1, -1], [0, -1, 0, -1]] = full[[0, 0, -1, -1], [0, -1, 0, -1]]
    a[20:30, 20:30] = full[20:30, 20:30]
    got = k.fill_between(a)
    assert np.isfinite(got[10:-10, 10:-10]).all() and np.allclose(got[np.isfinite(got)], full[np.isfinite(got)])
    for n, filled in ((40, True), (130, False)):  # a gap wider than twice the distance stays open in the middle
        b = np.full((60, n + 20), np.nan)
        b[:, :10], b[:, -10:] = 1, 2
        assert np.isfinite(k.fill_between(b)[10:-10, 10 + n // 2]).all() == filled and not (np.isfinite(k.fill_between(b)) < np.isfinite(b)).any()
    line = np.array([[4, np.nan, np.nan, np.nan, 8.0]])
    assert np.array_equal(k.fill_between(line), line, equal_nan=True)


def test_png():
    import zlib

    data = tables.png(np.arange(12, dtype=np.uint8).reshape(3, 4))
    at = data.index(b"IDAT")
    raw = zlib.decompress(data[at + 4 : at + 4 + int.from_bytes(data[at - 4 : at], "big")])
    assert raw == b"\0\0\1\2\3\0\4\5\6\7\0\10\11\12\13"


def _swath(turn, n=130, rows=40):
    """Pings on an arc with samples across it."""
    i = np.arange(n)
    way = i / n * turn
    e, north = 500_000 + np.cumsum(np.cos(way)) * 0.7, 3_200_000 + np.cumsum(np.sin(way)) * 0.7
    return [("a", "ss_port", 0, int(k), [float(k * 100 + r) for r in range(rows - k % 3)], float(e[k]), float(north[k]), float(e[k] - 30 * np.sin(way[k])), float(north[k] + 30 * np.cos(way[k]))) for k in i]


PINGS = "rec_id string, beam string, chunk_id int, record_num long, samples array<double>, e double, n double, range_e double, range_n double"


def test_rubber_sheet_by_blocks(spark):
    from soundings.operators import mosaic

    rows = _swath(2.0)
    df = spark.createDataFrame(rows, PINGS).repartition(5)
    key = lambda d: {(r["gx"], r["gy"]): r["v"] for r in d.collect()}
    whole = key(mosaic.rubber_sheet(df, 0.5, tile=8192))
    assert len(whole) > 6000
    for tile in (16, 256):
        got = mosaic.rubber_sheet(df, 0.5, tile=tile)
        assert key(got) == whole and got.count() == len(whole)
    at = np.array(sorted({*range(0, len(rows), 50), len(rows) - 1}))
    ends = [np.interp(np.arange(len(rows)), at, np.array([r[c] for r in rows])[at]) for c in (5, 6, 7, 8)]
    xs, ys = (np.arange(min(x for x, _ in whole) - 3, max(x for x, _ in whole) + 4) + 0.5) * 0.5, (np.arange(min(y for _, y in whole) - 3, max(y for _, y in whole) + 4) + 0.5) * 0.5
    image = np.stack([np.pad(r[4], (0, 40 - len(r[4]))) for r in rows], 1)
    out = np.full((len(ys), len(xs)), np.nan)
    for q in range(len(rows) - 1):
        k.warp_quad(out, xs, ys, np.array([ends[c][q + d] for d in (0, 1) for c in range(4)]), image[:, q : q + 2])
    r, c = np.nonzero(np.isfinite(out))
    want = {(int(np.floor(xs[j] / 0.5)), int(np.floor(ys[i] / 0.5))): out[i, j] for i, j in zip(r, c)}
    assert set(want) == set(whole) and np.mean([want[x] == whole[x] for x in want]) > 0.999  # ends differ in their last digits


def test_rubber_sheet_of_gaps_and_turns(spark):
    from soundings.operators import mosaic

    rows = _swath(12.0)
    rows[20] = (*rows[20][:4], None, *rows[20][5:])
    rows[50] = (*rows[50][:5], None, *rows[50][6:])  # a control point without a position
    far = [("b", "ss_port", 0, i, [1.0] * 4, 1000.0 * i, 0.0, 1000.0 * i, 30.0) for i in range(4)]  # a chunk of 3 km
    df = spark.createDataFrame(rows + far + [("c", "ss_port", 0, 0, [1.0], 0.0, 0.0, 0.0, 1.0)], PINGS)
    got = mosaic.rubber_sheet(df, 1.0, tile=64).groupBy("rec_id").agg(F.count("*").alias("n"), F.countDistinct("gx", "gy").alias("d")).collect()
    by = {r["rec_id"]: (r["n"], r["d"]) for r in got}
    assert by["b"] == (90_000, 90_000) and by["a"][0] == by["a"][1] > 100 and "c" not in by
    assert mosaic.rubber_sheet(df.limit(0), 1.0).count() == 0
