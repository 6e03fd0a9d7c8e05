"""Tile rows: files read by byte ranges, apertures over tile borders, features that do not depend on the tile."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skytable.operators import tiles
from skytable.sources import fits_tiles
from test_images import to_table


def card(key: str, value: str) -> bytes:
    return f"{key:<8}= {value:>20}".ljust(80).encode()


def unit(pixels: np.ndarray | None, kind: str, *more: tuple[str, str]) -> bytes:
    bits = {"u1": 8, "i2": 16, "i4": 32, "f4": -32, "f8": -64}[kind[-2:]]
    axes = [] if pixels is None else [("NAXIS1", str(pixels.shape[1])), ("NAXIS2", str(pixels.shape[0]))]
    cards = b"".join(card(k, v) for k, v in [("SIMPLE", "T"), ("BITPIX", str(bits)), ("NAXIS", str(len(axes))), *axes, *more]) + b"END".ljust(80)
    body = b"" if pixels is None else pixels.astype(kind).tobytes()
    return b"".join(x + fill * (-len(x) % 2880) for x, fill in ((cards, b" "), (body, b"\0")))


def test_files_by_byte_ranges(spark, tmp_path) -> None:
    rng = np.random.default_rng(2)
    images = {"big.fits": rng.normal(size=(70, 45)), "sub/two.FITS": 2.0 * rng.integers(-99, 99, (5, 33)) + 7, "one.fits": np.ones((1, 1))}
    (tmp_path / "sub").mkdir()
    (tmp_path / "big.fits").write_bytes(unit(None, ">f4") + unit(np.zeros((3, 3)), ">f4", ("EXTNAME", "'WHT'")) + unit(images["big.fits"], ">f8", ("EXTNAME", "'SCI'")))
    (tmp_path / "sub/two.FITS").write_bytes(unit((images["sub/two.FITS"] - 7) / 2, ">i2", ("BSCALE", "2.0"), ("BZERO", "7")))
    (tmp_path / "one.fits").write_bytes(unit(images["one.fits"], ">f4"))
    whole = unit(np.ones((40, 40)), ">f4")
    broken = {
        "cut.fits": whole[:4000], "noend.fits": b"SIMPLE  = T".ljust(2880), "empty.fits": b"", "nothing.fits": unit(None, ">f4"),
        "bits.fits": whole.replace(b"BITPIX  =                  -32", b"BITPIX  =                    7"), "axis.fits": whole.replace(b"NAXIS2  =                   40", b"NAXIS2  =                   xx"),
        "scale.fits": unit(np.ones((4, 4)), ">f4", ("BSCALE", "abc")),
    }
    for name, content in broken.items():
        (tmp_path / name).write_bytes(content)
    (tmp_path / "other.txt").write_bytes(b"x")
    for tile, span in ((16, 3000), (8, 1 << 20), (256, 64 << 20)):
        rows = fits_tiles.read_tiles(spark, str(tmp_path), tile, span).collect()
        for name, a in images.items():
            got = np.full(a.shape, np.nan)
            for r in rows:
                if r.path.endswith(name):
                    assert (r.h, r.w) == a.shape and r.y0 % tile == r.x0 % tile == 0 and r.reason is None
                    assert np.isnan(got[r.y0 : r.y0 + r.rows, r.x0 : r.x0 + r.cols]).all()
                    got[r.y0 : r.y0 + r.rows, r.x0 : r.x0 + r.cols] = np.reshape(r["values"], (r.rows, r.cols))
            assert np.allclose(got, a)
        reasons = {r.path.rsplit("/", 1)[1]: r.reason for r in rows if r.reason}
        assert set(reasons) == set(broken) and reasons["cut.fits"] == "data end early" and reasons["noend.fits"] == "header without end"
        assert "BSCALE" in reasons["scale.fits"] and "NAXIS2" in reasons["axis.fits"] and "7 bits" in reasons["bits.fits"]


def by_hand(a: np.ndarray, s: dict, fwhm: float | None) -> list:
    y, x = np.mgrid[: a.shape[0], : a.shape[1]]
    d = np.sqrt((x - s["x"]) ** 2 + (y - s["y"]) ** 2)
    inner, outer = (3.0, 8.0) if fwhm is None else (max(1.5, 1.5 * fwhm), max(4.0, 4 * fwhm))
    reach = lambda k: min(max(k * s["a"], 5.0), 200.0)

    def radius(share: float, most: float):
        total = a[d <= most].sum()
        for r in np.unique(d[d <= most]) if total > 0 else ():
            if a[d <= r].sum() >= share * total:
                return r
        return None

    dx, dy, c, n = x - s["x"], y - s["y"], np.cos(s["theta"]), np.sin(s["theta"])
    ell = np.sqrt(((dx * c + dy * n) / s["a"]) ** 2 + ((dy * c - dx * n) / s["b"]) ** 2)
    held = (ell <= 6) & (d <= max(outer, reach(6.0), reach(8.0)))
    top, bottom = (ell * a)[held].sum(), a[held].sum()
    kron = top / bottom if top > 0 and bottom > 0 else 0.0
    return [a[d <= inner].sum() / max(a[d <= outer].sum(), 1e-10), radius(0.25, reach(6.0)), radius(0.5, reach(8.0)), radius(0.75, reach(6.0)), kron]


@pytest.mark.parametrize("tile", [256, 32])
def test_apertures_over_tiles(spark, tile: int) -> None:
    rng = np.random.default_rng(7)
    field = rng.normal(0.2, 0.3, (90, 120))
    for cy, cx, width in ((20.3, 30.1, 2.5), (64.0, 32.0, 4.0), (88.0, 2.0, 3.0)):
        y, x = np.mgrid[:90, :120]
        field += 50 * np.exp(-((x - cx) ** 2 + (y - cy) ** 2) / 2 / width**2)
    pictures = [field, np.zeros((12, 9)), -np.ones((9, 12))]
    spots = [
        (0, 1, 30.1, 20.3, 2.6, 2.4, 0.3), (0, 2, 32.0, 64.0, 4.5, 3.0, -1.1), (0, 3, 2.0, 88.0, 3.0, 2.9, 0.0), (0, 4, 100.5, 45.5, 1.0, 0.2, 2.0),
        (1, 1, 4.2, 5.1, 2.0, 1.0, 0.0), (2, 1, 4.2, 5.1, 2.0, 1.0, 0.0),
    ]
    widths = {0: None, 1: 1.3, 2: 0.4}
    found = spark.createDataFrame(spots, "image_id long, object int, x double, y double, a double, b double, theta double")
    psf = spark.createDataFrame([(i, w) for i, w in widths.items()], "image_id long, psf_fwhm double")
    rows = tiles.tile_rows(to_table(spark, *pictures), tile)
    got = {(r.image_id, r.object): r for r in tiles.aperture_measures(found, rows, psf, tile).collect()}
    assert len(got) == len(spots)
    for s in spots:
        want = by_hand(pictures[s[0]], dict(zip(("image_id", "object", "x", "y", "a", "b", "theta"), s, strict=True)), widths[s[0]])
        r = got[s[:2]]
        for a, b in zip((r.concentration, r.r25, r.r50, r.r75, r.kron_radius), want, strict=True):
            assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, rel=1e-9, abs=1e-9))
        assert r.compact == (want[-1] < 1)


def test_pixels_and_tiles_are_inverse(spark) -> None:
    rng = np.random.default_rng(9)
    table = to_table(spark, rng.normal(size=(7, 11)), rng.normal(size=(1, 1)), rng.normal(size=(5, 4)))
    back = tiles.pixel_rows(tiles.tile_rows(table, 4)).select(table.columns)
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in table.collect()}
    # A pixel without a row is 0; missing and infinite values have stated ones.
    holes = tiles.tile_rows(table.filter("not (image_id = 0 and y = 3 and x = 5)"), 4)
    assert tiles.pixel_rows(holes).filter("image_id = 0 and y = 3 and x = 5").first()["v"] == 0.0
    odd = spark.createDataFrame([([float("nan"), float("inf"), float("-inf"), 1.0, None],)], "values array<double>")
    top = float(np.finfo("f8").max)
    assert tiles.cleaned(odd).first()[0] == [0.0, top, -top, 1.0, 0.0]
    assert tiles.morphology(tiles.tile_rows(table.filter(F.lit(False)))).count() == 0
