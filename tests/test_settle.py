"""One round on the flat plane tells the groups of all rows that it settles, not only the founders."""

import numpy as np
import pyarrow as pa
import pytest

from skytable.operators import grouping

TOLERANCE = 1 / 3600
SIDE = TOLERANCE / 2**0.5 * (1 - 1e-9)


def block(n, spread, seed, dec=0.001):
    r = np.random.default_rng(seed)
    ra, dec = 1e-3 + r.uniform(0, spread, n), dec + r.uniform(0, spread, n)
    cu, cv = np.floor(ra / SIDE).astype("int64"), np.floor(dec / SIDE).astype("int64")
    zero, yes = np.zeros(n, "int64"), np.ones(n, bool)
    return pa.table({"_bu": zero, "_bv": zero, "seq": r.permutation(n), "ra": ra, "dec": dec, "cu": cu, "cv": cv, "own": yes, "last": ~yes})


@pytest.mark.parametrize("spread", [0.1, 0.01, 0.003])
def test_homes_of_a_block(spread):
    rows = block(400, spread, 3)
    founders, want = [], {}
    for r in sorted(rows.to_pylist(), key=lambda r: r["seq"]):
        home = next((f for f in founders if grouping._flat_match(r["ra"], r["dec"], f["ra"], f["dec"], TOLERANCE)), r)
        if home is r:
            founders.append(r)
        want[r["seq"]] = home["seq"]
    got = grouping._settle(rows, TOLERANCE).to_pylist()
    assert {r["seq"]: r["home_seq"] for r in got} == want


def test_rows_by_the_border_stay_open():
    rows = block(2, 1e-9, 1)
    mine = np.array(rows["seq"]) == 1
    got = grouping._settle(rows.set_column(7, "own", pa.array(mine)), TOLERANCE).to_pylist()
    assert [(r["seq"], r["home_seq"]) for r in got] == [(1, None)]
