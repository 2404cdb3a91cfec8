import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulse.llm import ann, topk, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, id string, vector string"


def rows(n=300, dims=12, ties=60):
    r = np.random.default_rng(3)
    out = [(i, r.normal(size=dims).astype(np.float32).tolist(), 0, "x", "y") for i in range(n)]
    out += [(n + i, out[0][1], 0, None, None) for i in range(ties)]  # a hot vector
    out += [(-1, None, 0, "", ""), (-2, [None] + [1.0] * (dims - 1), 0, "", ""), (-3, [math.nan] * dims, 0, "", ""),
            (-4, [math.inf] + [0.0] * (dims - 1), 0, "", ""), (-5, [0.0] * dims, 0, "", ""), (-6, [1.0, 2.0], 0, "", ""), out[5], out[50]]
    return out


def usable(spark, data, dims=12):
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    return df.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")).where(vectors.usable(F.col("vector")))


def plain(data, dims=12):
    ok = [(i, v + [0.0] * (dims - len(v))) for i, v, *_ in data if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    return np.array([i for i, _ in ok]), np.array([v for _, v in ok], float)


@pytest.mark.parametrize("block,resolve", [(4096, 64), (64, 5)])
def test_top_k_equals_brute_force(llm, block, resolve):
    data = rows()
    ids, x = plain(data)
    x = np.floor(256 * x)
    whole = F.transform("vector", lambda v: F.floor(v.cast("double") * 256).cast("double"))
    df = usable(llm, data).select("id", whole.alias("vector"))
    got = {}
    for r in topk.top_k(df, F.col("id") % 50 == 0, 5, 12, block, resolve).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    queries = sorted({int(i) for i in ids if i % 50 == 0})
    assert sorted(got) == queries
    for q in queries:
        s = x @ x[np.flatnonzero(ids == q)[0]]
        may = np.flatnonzero(ids != q)
        first = may[np.lexsort((ids[may], -s[may]))[:5]]
        assert sorted(got[q]) == [(k + 1, ids[i], int(s[i])) for k, i in enumerate(first)]


def test_copies_of_the_queries_never_pass_through_the_driver(llm):
    """300 rows in 75 blocks: Spark takes the copied queries for as small as they were before, and they are not broadcast."""
    got = topk.top_k(usable(llm, rows()), F.col("id") % 2 == 0, 5, 12, 4)
    assert len(got.collect()) > 500
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_neighbours_have_exact_distances_and_recall(llm):
    data = [r for r in rows() if r[0] != -5]
    ids, x = plain(data)
    found = ann.search(usable(llm, data), F.col("id") % 100 == 0, 10, 12, tables=8, probes=12).collect()
    by = {}
    for r in found:
        by.setdefault(r["query_id"], []).append(r)
    hit = total = 0
    for q in sorted({int(i) for i in ids if i % 100 == 0}):
        d = np.sqrt(((x - x[np.flatnonzero(ids == q)[0]]) ** 2).sum(1))
        best = {int(i): far for i, far in zip(ids, d, strict=True)}
        order = sorted((far, int(i)) for i, far in zip(ids, d, strict=True) if i != q)[:10]
        order = [i for _, i in order]
        got = sorted(by[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in got] == list(range(1, 11))
        assert all(abs(r["score"] - best[r["vec_id"]]) < 1e-12 for r in got)
        assert [(r["score"], r["vec_id"]) for r in got] == sorted((r["score"], r["vec_id"]) for r in got)
        hit, total = hit + sum((Counter(r["vec_id"] for r in got) & Counter(order)).values()), total + 10
    assert hit >= 0.9 * total


def test_a_row_that_stands_twice_is_found_twice(llm):
    x = np.random.default_rng(1).normal(size=(40, 12)).astype(np.float32)
    data = [(i, v.tolist(), 0, "", "") for i, v in enumerate(x)] + [(7, x[0].tolist(), 0, "", "")] * 3
    found = ann.search(usable(llm, data), F.col("id") == 0, 5, 12, tables=4, probes=4).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in found[:3]] == [(7, 0.0)] * 3 and found[3]["score"] > 0 and len(found) == 5


@pytest.mark.parametrize("n,width", [(500, 1), (2000, 1), (51_000, 2), (10_000_000, 3)])
def test_buckets_grow_with_the_table(n, width):
    assert ann.functions_for(n, 64) == width


def test_probes_are_the_nearest_combinations():
    x = np.random.default_rng(3).normal(size=(5, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sides = [ann.rotated(x, 1, f, 5) for f in range(2)]
    got = ann.nearest_buckets(x, 1, 2, 9, 5)
    for i in range(5):
        gaps = [(s[i].max() - s[i]) ** 2 for s in sides]
        costs = (gaps[0][:, None] + gaps[1][None, :]).ravel()
        assert np.allclose(costs[got[i]], np.sort(costs)[:9]) and len(set(got[i])) == 9
        assert got[i][0] == ann.nearest_buckets(x, 1, 2, 1, 5)[i][0]


@pytest.mark.parametrize("chunk,query,fill", [(1 << 16, 4096, 0.05), (40, 7, 8)])
def test_concatenated_functions_and_pieces_of_hot_buckets(llm, monkeypatch, chunk, query, fill):
    """A clustered table: most rows near one axis; recall stays, and few rows are met."""
    monkeypatch.setattr(ann, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(ann, "QUERY_ROWS", query)
    monkeypatch.setattr(ann, "ASKED_ROWS", query)
    monkeypatch.setattr(ann, "FILL", fill)
    r = np.random.default_rng(4)
    centres = r.normal(size=(30, 12))
    x = (centres[np.minimum(r.integers(0, 45, 1500), 29)] + 0.2 * r.normal(size=(1500, 12))).astype(np.float32)  # a third at one centre
    data = [(i, v.tolist(), 0, "", "") for i, v in enumerate(x)]
    found = ann.search(usable(llm, data), F.col("id") % 20 == 0, 10, 12, tables=8, probes=8).collect()
    by = {}
    for f in found:
        by.setdefault(f["query_id"], []).append((f["rank"], f["vec_id"]))
    hit = sum(len({v for _, v in by[q]} & set(nearest(x.astype(float), q))) for q in range(0, 1500, 20))
    assert all(sorted(p for p, _ in v) == list(range(1, 11)) for v in by.values()) and hit >= 0.9 * 750


def test_recall_on_the_table(llm):
    from pulse.llm.queries import op10_ann_cross_polytope

    d = "/root/testdata/sf0.01"
    table = llm.read.parquet(f"{d}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r["vec_id"] for r in table]), np.array([r["embedding"] for r in table], float)
    hit = total = 0
    by = {}
    for r in op10_ann_cross_polytope(llm, d).collect():
        by.setdefault(r["query_id"], set()).add(r["vec_id"])
    for q in ids[ids % 100 == 0]:
        d2 = ((x - x[ids == q]) ** 2).sum(1)
        d2[ids == q] = np.inf
        hit, total = hit + len(by[q] & set(ids[np.argsort(d2)[:10]].tolist())), total + 10
    assert hit >= 0.9 * total


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(1).normal(size=(5, 16))
    assert np.allclose(np.linalg.norm(ann.hadamard(x.T), axis=0), np.linalg.norm(x, axis=1))


def test_empty_and_few(llm):
    none = usable(llm, [rows()[0]]).where("false")
    assert topk.top_k(none, F.col("id") % 50 == 0, 5, 12).count() == 0
    assert ann.search(none, F.col("id") % 50 == 0, 5, 12).count() == 0
    two = usable(llm, rows()[:2])
    assert topk.top_k(two, F.col("id") % 50 == 0, 5, 12).count() == 1


def nearest(x, q, k=10):
    """Places of the k nearest other rows of x, by distance and place."""
    far = np.sqrt(((x - x[q]) ** 2).sum(1))
    return [i for i in np.lexsort((np.arange(len(x)), far)) if i != q][:k]


@pytest.mark.parametrize("n", [2, 9, 12])
def test_small_tables_lose_no_neighbour(llm, n):
    x = np.random.default_rng(n).normal(size=(n, 64)).astype(np.float32)
    data = [(i, v.tolist(), 0, "", "") for i, v in enumerate(x)]
    found = ann.search(usable(llm, data), F.col("id") % 100 < n, 10, 64, tables=8, probes=20).collect()
    got = {q: [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q] for q in range(n)}
    assert [len(got[q]) for q in range(n)] == [min(10, n - 1)] * n
    if n <= 11:  # all candidates
        assert got == {q: nearest(x.astype(float), q) for q in range(n)}


def test_query_far_from_a_cluster(llm, monkeypatch):
    monkeypatch.setattr(ann, "CHUNK_ROWS", 700)  # several blocks
    r = np.random.default_rng(2)
    axis = r.normal(size=64)
    x = np.concatenate([[-axis], axis + 0.001 * r.normal(size=(3000, 64))]).astype(np.float32)
    data = [(i, v.tolist(), 0, "", "") for i, v in enumerate(x)]
    found = ann.search(usable(llm, data), F.col("id") == 0, 10, 64, tables=8, probes=20).collect()
    assert [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"])] == nearest(x.astype(float), 0)


def test_null_ids_take_no_part_and_a_hot_id_is_dealt_out(llm, monkeypatch):
    r = np.random.default_rng(6)
    x = r.integers(-50, 50, size=(600, 12)).astype(np.float32)
    ids = [None] * 100 + [7] * 300 + list(range(100, 300))  # one id holds half of the rows
    df = usable(llm, [(i, v.tolist(), 0, "", "") for i, v in zip(ids, x, strict=True)])
    sizes, packed = [], vectors.pack

    def counted(rows, by, kind):
        if by in (["block"], ["chunk"]):
            sizes.extend(n for _, n in rows.groupBy(*by).count().collect())
        return packed(rows, by, kind)

    monkeypatch.setattr(topk, "pack", counted)
    got = topk.top_k(df, F.col("id") % 50 == 0, 5, 12, 64).collect()
    assert max(sizes) <= 130 and sum(sizes) == 500
    assert {q["query_id"] for q in got} == {100, 150, 200, 250}
    assert all(q["vec_id"] == 7 or 100 <= q["vec_id"] < 300 for q in got)
    monkeypatch.setattr(ann, "pack", counted)
    monkeypatch.setattr(ann, "CHUNK_ROWS", 64)
    sizes.clear()
    # far more neighbours than buckets hold: every row is packed for the exact search
    found = ann.search(df, F.col("id") % 50 == 0, 400, 12, tables=1, probes=1).collect()
    assert max(sizes) <= 130 and sum(sizes) == 500
    assert {q["query_id"] for q in found} == {100, 150, 200, 250} and len(found) == 4 * 400  # 7 stands 300 times, for itself each time
    assert all(q["vec_id"] == 7 or 100 <= q["vec_id"] < 300 for q in found)
