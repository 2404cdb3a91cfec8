import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulse.llm import metric_join as mj

SCHEMA = "vec_id long, embedding array<float>, node string, cell int, vector string"
DIMS = 16


def table(groups=6, size=40, noise=200, spread=0.08, hot=120, seed=3):
    r = np.random.default_rng(seed)
    out, n = [], 0
    for _ in range(groups):
        centre = r.normal(size=DIMS)
        for _ in range(size):
            out.append((n, (centre + spread * np.linalg.norm(centre) * r.normal(size=DIMS) * r.choice([.3, 1, 2])).astype(np.float32).tolist()))
            n += 1
    for _ in range(noise):
        out.append((n, r.normal(size=DIMS).astype(np.float32).tolist()))
        n += 1
    near = r.normal(size=DIMS)
    out += [(n + i, (near + 0.02 * r.normal(size=DIMS)).astype(np.float32).tolist()) for i in range(hot)]  # one large group of near copies
    out += [(n + hot + i, out[3][1]) for i in range(hot)]  # and of exact ones
    scaled = [(5000 + i, [1e4 * x for x in out[i][1]]) for i in range(5)]
    odd = [(9000, None), (9001, [0.0] * DIMS), (9002, [-0.0] * DIMS), (9003, [math.nan] * DIMS), (9004, [None] + [1.0] * (DIMS - 1)),
           (9005, [math.inf] + [1.0] * (DIMS - 1)), (9006, [1.0, 2.0]), (9007, [1.0, 2.0, -0.0]), (7, out[300][1]), (None, out[0][1]), (None, [3.0]), out[9], out[9]]
    return out + scaled + odd


def plain(rows, least):
    ids = [i for i, _ in rows]
    ok = [v is not None and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v) for _, v in rows]
    x = np.array([[*v, *[0.0] * (DIMS - len(v))] if good else [0.0] * DIMS for (_, v), good in zip(rows, ok, strict=True)], np.float32).astype(float)
    n = np.linalg.norm(x, axis=1)
    links = (x @ x.T / np.where(n > 0, n, 1)[:, None] / np.where(n > 0, n, 1)[None, :]) >= least
    np.fill_diagonal(links, False)
    label = np.arange(len(rows))
    while True:
        new = np.array([min(label[i], label[links[i]].min(initial=label[i])) for i in range(len(rows))])
        if (new == label).all():
            break
        label = new
    out = []
    for i in range(len(rows)):
        named = [ids[j] for j in np.flatnonzero(label == label[i]) if ids[j] is not None]
        out.append((ids[i], int(links[i].sum()), min(named) if named else None))
    return sorted(out, key=repr)


def frame(spark, rows):
    df = spark.createDataFrame([(i, v, "clash", 0, "clash") for i, v in rows], SCHEMA).repartition(5)
    return df.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def found(spark, rows, least, **sizes):
    return sorted((tuple(r) for r in mj.components(frame(spark, rows), least, **sizes).collect()), key=repr)


@pytest.mark.parametrize("least,sizes", [(0.9, {}), (0.9, {"block_rows": 16, "cell_rows": 40}), (0.7, {"block_rows": 64, "cell_rows": 100}), (0.97, {"cell_rows": 60})])
def test_links_and_components_equal_brute_force(llm, least, sizes):
    assert found(llm, table(), least, **sizes) == plain(table(), least)


def test_chain_of_links_is_one_component(llm):
    angles = np.arange(60) * 0.2
    rows = [(100 - i, [float(np.cos(a / 12)), float(np.sin(a / 12))] + [0.0] * (DIMS - 2)) for i, a in enumerate(angles)]
    got = found(llm, rows, 0.9998, cell_rows=5, block_rows=4)
    assert got == plain(rows, 0.9998) and len({r[2] for r in got}) == 1


def test_every_link_is_met_in_one_cell():
    """The copies that the triangle inequality allows hold both ends of every link."""
    x = mj.directions(np.array([v for _, v in table()[:680] if v is not None], float))
    reach = math.sqrt(0.2)
    pivots = mj.pivots_of(x[::3], reach, 12)
    d = mj.apart(x @ pivots.T)
    home = d.argmin(axis=1)
    assert len(pivots) > 6
    for i, j in zip(*np.nonzero(x @ x.T >= 0.9), strict=True):
        if home[i] < home[j]:
            assert d[j, home[i]] <= d[j, home[j]] + 2 * reach + mj.SLACK


def test_dense_groups_share_one_pivot():
    r = np.random.default_rng(1)
    x = mj.directions(np.concatenate([r.normal(size=DIMS) + 0.02 * r.normal(size=(300, DIMS)), r.normal(size=(100, DIMS))]))
    pivots = mj.pivots_of(x, math.sqrt(0.2), 4)
    assert len(pivots) <= 6 and (pivots @ x[0] > 0.9).sum() == 1


def test_a_large_group_of_near_copies_is_counted_and_not_tested(llm):
    r = np.random.default_rng(2)
    centre = r.normal(size=DIMS)
    rows = [(i, (centre + 0.02 * r.normal(size=DIMS)).astype(np.float32).tolist()) for i in range(3000)]
    got = found(llm, rows, 0.9, block_rows=64)
    assert all(x[1] == 2999 and x[2] == 0 for x in got) and len(got) == 3000


def test_borderline_cosines_are_decided_in_double_precision():
    x = np.array([[1.0, 0.0]])
    y = np.array([[0.9, math.sqrt(1 - 0.81)], [0.9 - 1e-12, math.sqrt(1 - (0.9 - 1e-12) ** 2)], [0.9 + 1e-12, math.sqrt(1 - (0.9 + 1e-12) ** 2)]])
    assert mj.links_between(x, y, 0.9).tolist() == [[True, False, True]]


def test_empty_and_single(llm):
    assert found(llm, [], 0.9) == []
    assert found(llm, [(4, None)], 0.9) == [(4, 0, 4)]
    assert found(llm, [(4, [1.0])], 0.9) == [(4, 0, 4)]
