"""Rows that meet at several places of a group travel and are told once."""

import numpy as np

from scene_analytics.operators import descent


def test_meetings_of_a_group_are_told_once(spark):
    rng = np.random.default_rng(5)
    n, least = 40, 0.1
    codes, scale = descent._codes(rng.normal(size=(n, 8)))
    told = spark.createDataFrame([(i, bytearray(codes[i].tobytes()), float(scale[i]), least) for i in range(n)], "vec_id long, code binary, scale float, least float")
    who = [(c, int(m), bool(rng.random() < 0.5)) for c in range(n) for m in rng.choice(n, 12)]
    found = descent._meetings(told, spark.createDataFrame(who, "center long, member long, fresh boolean"), descent.LOT_ROWS).collect()
    x = codes.astype(np.float32) * scale[:, None]
    s, near = x @ x.T, set()
    for c in range(n):
        new, met = ({m for d, m, f in who if d == c and (f or every)} for every in (False, True))
        near |= {p for a in new for b in met if a != b and s[a, b] > least for p in ((a, b), (b, a))}
    assert len(found) == len({(r.src, r.dst) for r in found}) and {(r.src, r.dst) for r in found} == near
    assert max(abs(r.sim - s[r.src, r.dst]) for r in found) < 1e-6
