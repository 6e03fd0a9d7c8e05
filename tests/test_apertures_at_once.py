"""The apertures of many detections on tiles of different shapes are measured in one call."""

import numpy as np

from skytable.operators import tiles


def test_against_every_pixel():
    r = np.random.default_rng(5)
    shapes, starts = [(3, 4), (5, 2), (6, 6)], [(0, 0), (3, 4), (10, 10)]
    images = [r.uniform(0, 1, s) for s in shapes]
    tile = np.array([0, 0, 1, 2, 2, 1])
    place = {c: np.array([(*starts[t], *shapes[t])[i] for t in tile]) for i, c in enumerate(["y0", "x0", "rows", "cols"])}
    s = {c: r.uniform(0, 9, 6) for c in ("x", "y")} | {c: r.uniform(0.5, 2, 6) for c in ("a", "b", "theta")}
    s |= {f"r_{c}": r.uniform(1, 5, 6) for c in ("inner", "outer", "flux", "half")} | {"reach": np.full(6, 5.0)}
    s["x"][5], s["y"][5] = 90.0, 90.0
    sums, reached, (owner, square, light) = tiles._apertures(images, tile, place, s)
    assert not reached[5] and reached[:2].all()
    for k in range(6):
        y, x = np.mgrid[place["y0"][k] : place["y0"][k] + place["rows"][k], place["x0"][k] : place["x0"][k] + place["cols"][k]]
        d2, v = (y - s["y"][k]) ** 2 + (x - s["x"][k]) ** 2, images[tile[k]]
        want = [v[d2 <= s[f"r_{c}"][k] ** 2].sum() for c in ("inner", "outer", "flux", "half")]
        assert np.allclose([c[k] for c in sums[:4]], want)
        near = d2 <= max(s["r_flux"][k], s["r_half"][k]) ** 2
        assert np.allclose(light[owner == k].sum(), v[near].sum())
        assert np.allclose(square[owner == k], np.unique(d2[near]))
