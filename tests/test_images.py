"""Image operators against whole-image numpy, with tiles smaller than the images."""

import numpy as np
import pandas as pd
import pytest

from skytable.operators import images, tiles


def pixel_frame(image_id, a):
    y, x = np.mgrid[: a.shape[0], : a.shape[1]]
    return pd.DataFrame({"image_id": image_id, "h": a.shape[0], "w": a.shape[1], "y": y.ravel(), "x": x.ravel(), "v": a.ravel().astype(float)})


def to_table(spark, *pictures):
    rows = pd.concat([pixel_frame(i, p) for i, p in enumerate(pictures)])
    return spark.createDataFrame(rows, images.PIXEL_SCHEMA)


def flood(mask, diagonal):
    labels, n = np.zeros(mask.shape, int), 0
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if diagonal else [])
    for start in zip(*np.where(mask)):
        if labels[start]:
            continue
        n += 1
        labels[start] = n
        stack = [start]
        while stack:
            y, x = stack.pop()
            for dy, dx in steps:
                p = (y + dy, x + dx)
                if 0 <= p[0] < mask.shape[0] and 0 <= p[1] < mask.shape[1] and mask[p] and not labels[p]:
                    labels[p] = n
                    stack.append(p)
    return labels, n


@pytest.mark.parametrize("diagonal", [False, True])
def test_components_across_tiles(spark, diagonal):
    a = (np.random.default_rng(4).random((37, 29)) < (0.5 if not diagonal else 0.3)).astype(float)
    labels, n = flood(a > 0, diagonal)
    got = images.label_pixels(to_table(spark, a).filter("v > 0"), diagonal, tile=5).toPandas()
    want = {}
    for k in range(1, n + 1):
        y, x = np.where(labels == k)
        want[k] = int((y * a.shape[1] + x).min())
    assert all(want[labels[r.y, r.x]] == r.comp for r in got.itertuples())
    assert len(got) == int(a.sum())


def blurred(a, sigma):
    reach = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    w /= w.sum()
    p = np.pad(a, reach, mode="symmetric")
    p = sum(w[i] * p[i : i + a.shape[0], :] for i in range(len(w)))
    return sum(w[i] * p[:, i : i + a.shape[1]] for i in range(len(w)))


def test_morphology_of_large_and_small_images(spark):
    r = np.random.default_rng(8)
    big, small, flat = r.normal(5, 1, (130, 70)), r.normal(0, 1, (9, 14)), np.full((6, 6), 2.0)
    big[60:64, 30:34] += 40
    small[0, 0] = np.nan
    got = tiles.morphology(tiles.tile_rows(to_table(spark, big, small, flat), 64), 64).toPandas().set_index("image_id")
    for i, a in enumerate((big, np.nan_to_num(small))):
        f = got.loc[i]
        h, w = a.shape
        var, side = a.var(), min(h, w)
        assert np.isclose(f.e1, blurred(a, 1.0).var() / var)
        assert np.isclose(f.e4, blurred(a, 3.0).var() / var)
        assert np.isclose(f.e16, blurred(a, max(4.0, min(12.0, side / 5))).var() / var)
        assert np.isclose(f.asymmetry, np.abs(a - a[::-1, ::-1]).sum() / (2 * np.abs(a).sum()))
        s = np.sort(np.abs(a).ravel())
        n = s.size
        assert np.isclose(f.gini, 2 * (np.arange(1, n + 1) * s).sum() / (n * s.sum()) - (n + 1) / n)
        y, x = np.mgrid[:h, :w]
        rad = np.hypot(x - w / 2, y - h / 2).ravel()
        order = np.argsort(rad, kind="stable")
        cum = np.abs(a).ravel()[order].cumsum()
        assert np.isclose(f.half_light_radius, rad[order][np.searchsorted(cum, 0.5 * cum[-1])])
        moment = np.abs(a).ravel() * rad**2
        down = np.argsort(-np.abs(a).ravel(), kind="stable")
        cum = np.abs(a).ravel()[down].cumsum()
        inside = cum <= 0.2 * cum[-1]
        inside[0] = True
        assert np.isclose(f.m20, np.log10(moment[down][inside].sum() / moment.sum()))
        assert f.n_sources == flood(a > a.mean() + 3 * a.std(), False)[1]
        assert np.isclose(f.kurtosis_val, (((a - a.mean()) / a.std()) ** 4).mean() - 3)
    assert got.loc[2].drop("min_dim").abs().sum() == 0 and got.loc[2].min_dim == 6


def test_equal_pixels_enter_by_position(spark):
    a = np.zeros((8, 8))
    a.ravel()[:20] = 1.0
    p = to_table(spark, a)
    sums = images.image_sums(p)
    y, x = np.mgrid[:8, :8]
    moment = (a * ((x - 4) ** 2 + (y - 4) ** 2)).ravel()
    want = np.log10(moment[16:20].sum() / moment.sum())
    assert np.isclose(images.bright_moment(p, sums).first().m20, want)


def test_quantiles(spark):
    r = np.random.default_rng(2)
    values = np.concatenate([r.normal(0, 1, 500), np.zeros(300), r.lognormal(0, 3, 200)])
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "v": values}))
    got = images.exact_quantiles(df, ["k"], "v", {"a": 0.05, "b": 0.5, "c": 0.995}).first()
    assert np.allclose([got.a, got.b, got.c], np.quantile(values, [0.05, 0.5, 0.995]))


def test_all_nan_image_becomes_zero(spark):
    p = to_table(spark, np.full((3, 3), np.nan))
    assert {r.v for r in images.fill_missing(p).collect()} == {0.0}
