import itertools

import numpy as np
import pandas as pd
import pytest

from tidelag.llm import knn, outrank, queries, topn
from tidelag.llm.sql import ORACLE


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_equal_their_sql(spark, oracle, name):
    oracle(spark, queries.queries()[name], ORACLE[name])


# ---- top N ----


def best(rows, n):
    each = {}
    for g, s, e, c in rows:
        if s is not None and s == s:
            k = (g, e, c)
            each[k] = max(each.get(k, -np.inf), s)
    out = {}
    for (g, e, c), s in each.items():
        out.setdefault(g, []).append((-s, e is None, e or 0, c is None, (c or "").encode(), e, c))
    return {(g, x[5], x[6], i + 1) for g, xs in out.items() for i, x in enumerate(sorted(xs)[:n])}


TOP = "target string, rho double, E int, `column` string, s double, g0 string, place string"


def test_top_n_edge_cases(spark):
    rng = np.random.default_rng(1)
    names = ["a", "B", "é", "Z", "", None, "z\U0001f600", "zz"]
    rows = [("hot" if rng.uniform() < 0.5 else f"t{rng.integers(0, 40)}", float(np.round(rng.normal(), 1)), int(rng.integers(1, 4)), names[rng.integers(0, 8)]) for _ in range(4000)]
    rows += [(None, 1.0, 1, "a"), (None, 2.0, None, "a"), ("t1", None, 1, "a"), ("t1", float("nan"), 1, "a"), ("inf", float("inf"), 1, "a"), ("inf", -float("inf"), 1, "b"), ("zero", -0.0, 1, "a"), ("zero", 0.0, 1, "B")] + rows[:50]
    df = spark.createDataFrame([(*r, 1.0, "x", "y") for r in rows], TOP).repartition(7)
    got = topn.top_n(df, "target", "rho", ["E", "column"], 3)
    assert {(r.target, r.E, r["column"], r.place) for r in got.collect()} == best(rows, 3)
    assert got.count() == len(best(rows, 3))
    assert topn.top_n(df.limit(0), "target", "rho", ["E", "column"], 3).count() == 0
    with pytest.raises(ValueError):
        topn.top_n(df, "target", "rho", ["E"], 0)


def test_heaps_are_trimmed_and_passed_on(monkeypatch):
    """The stages run apart with small limits: many flushes before the shuffle lose nothing."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    rows = pd.DataFrame({"g0": [f"g{int(x)}" for x in rng.exponential(20, 6000)], "t0": rng.integers(0, 9, 6000), "t1": rng.integers(0, 500, 6000).astype(str), "s": np.round(rng.normal(size=6000), 1)})
    want = best(rows[["g0", "s", "t0", "t1"]].itertuples(index=False, name=None), 4)
    for gather, keep in ((500, 1 << 20), (500, 60)):
        monkeypatch.setattr(topn, "GATHER", gather)
        monkeypatch.setattr(topn, "KEEP", keep)
        parts = [pa.Table.from_pandas(rows.iloc[i : i + 2000], preserve_index=False).to_batches(max_chunksize=150) for i in range(0, 6000, 2000)]
        kept = pd.concat([b.to_pandas() for p in parts for b in topn._partial(["g0"], ["t0", "t1"], 4)(iter(p))])
        kept = pa.Table.from_pandas(kept.sort_values("g0", kind="stable"), preserve_index=False)
        got = pd.concat([b.to_pandas() for b in topn._merge(["g0"], ["t0", "t1"], 4)(iter(kept.to_batches(max_chunksize=90)))])
        assert {(r.g0, r.t0, r.t1, r.place + 1) for r in got.itertuples()} == want


# ---- net flow ----


def flow(items, scores, q, full):
    """Net flow by all pairs."""
    n = len(items)
    out = {}
    for i, a in enumerate(items):
        total = 0.0
        for c, sign in scores.items():
            col = sorted(sign * x[c] for x in items)
            p = [(col.index(sign * x[c]) + (col.count(sign * x[c]) - 1) / 2) / (n - 1) if n > 1 else 0.5 for x in items]
            for j in range(n):
                if j != i:
                    d = p[i] - p[j]
                    f = (lambda v: float(v > 1e-11)) if full == 0 else (lambda v: min(1.0, max(0.0, (v - q) / (full - q))))
                    total += (f(d) - f(-d)) / (n - 1) / len(scores)
        out[a["combo_id"]] = total
    return out


@pytest.mark.parametrize("q,full", [(0.0, 0.0), (0.0, 0.25), (0.1, 0.4)])
@pytest.mark.parametrize("rows_in_bin", [1 << 20, 5])
def test_net_flow_equals_all_pairs(spark, monkeypatch, q, full, rows_in_bin):
    monkeypatch.setattr(outrank, "BIN_ROWS", rows_in_bin)
    rng = np.random.default_rng(8)
    scores = {"rho": 1, "MAE": -1}
    rows = [{"run": r, "combo_id": i, "rho": float(np.round(rng.uniform(-1, 1), 1)), "MAE": float(rng.lognormal(3 * r, 3)) if i % 5 else 7.0} for r, n in ((0, 1), (1, 2), (2, 37)) for i in range(n)]
    df = spark.createDataFrame(pd.DataFrame([{**x, "g": "clash", "j": 3, "item": 1} for x in rows + rows[:9]]))
    got = {(r.run, r.combo_id): r.net_flow for r in outrank.net_flow(df, ["run"], "combo_id", scores, indifference=q, full=full).collect()}
    want = {(r, k): v for r in (0, 1, 2) for k, v in flow([x for x in rows if x["run"] == r], scores, q, full).items()}
    assert got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in want) < 1e-9


def test_net_flow_edge_cases(spark):
    schema = "run long, id long, a double, b double, c double"
    bad = [(1, 9, None, 1.0, 1.0), (1, 8, float("nan"), 1.0, 1.0), (1, 7, 1.0, float("inf"), 1.0)]
    rows = [(1, 1, 0.5, 3.0, 1.0), (1, 2, 0.5, 2.0, 1.0), (None, 3, 1.0, 1.0, 1.0), (None, None, 2.0, 0.5, 1.0), *bad]
    scores = {"a": 1, "b": -1, "c": -1}
    df = spark.createDataFrame(rows, schema)
    got = {(r.run, r.id): round(r.net_flow, 9) for r in outrank.net_flow(df, ["run"], "id", scores).collect()}
    assert got == {(1, 1): round(-1 / 3, 9), (1, 2): round(1 / 3, 9), (None, 3): round(-2 / 3, 9), (None, None): round(2 / 3, 9)}
    assert outrank.net_flow(df.limit(0), ["run"], "id", scores).count() == 0
    with pytest.raises(ValueError):
        outrank.net_flow(df, ["run"], "id", scores, indifference=0.5, full=0.2)


def test_majority_winners(spark, monkeypatch):
    rng = np.random.default_rng(3)
    scores = {"a": 1, "b": -1, "c": -1}
    rows, want = [], set()
    for run in range(60):
        items = [tuple(np.round(rng.normal(size=3), 1).tolist()) for _ in range(int(rng.integers(1, 9)))]
        sign = np.array([1, -1, -1])
        for i, x in enumerate(items):
            if all(sum(np.array(x) * sign > np.array(y) * sign) >= 2 for j, y in enumerate(items) if j != i):
                want.add((run, i))
        rows += [(run, i, *x) for i, x in enumerate(items)]
    f = spark.createDataFrame(rows, "run long, id long, a double, b double, c double").repartition(5)
    assert {tuple(r) for r in outrank.majority_winners(f, "run", "id", scores).collect()} == want
    assert 10 < len(want) < 60
    monkeypatch.setattr(outrank, "BIN_ROWS", 4)  # larger groups are split
    monkeypatch.setattr(outrank, "PARTS", 3)
    assert {tuple(r) for r in outrank.majority_winners(f, "run", "id", scores).collect()} == want
    clash = f.selectExpr("CAST(NULL AS LONG) AS run", "id", "a", "b", "c", "1 AS k0", "2 AS item", "3 AS v0").where("id < 3").unionByName(f.selectExpr("run", "id", "a", "b", "c", "1 AS k0", "2 AS item", "3 AS v0"))
    assert want <= {tuple(r)[:2] for r in outrank.majority_winners(clash, "run", "id", scores).collect()}
    assert outrank.majority_winners(f.limit(0), "run", "id", scores).count() == 0
    with pytest.raises(ValueError):
        outrank.majority_winners(f, "run", "id", {"a": 1})


# ---- nearest vectors ----


@pytest.mark.parametrize("most", [1 << 14, 4])
def test_nearest_is_exact_over_many_blocks(spark, monkeypatch, most):
    monkeypatch.setattr(knn, "MOST_BLOCKS", most)  # four blocks are cut on in place
    rng = np.random.default_rng(7)
    x = np.vstack([rng.normal(size=(500, 3)), rng.normal(5, 0.01, size=(300, 3)), np.round(rng.normal(size=(200, 3)), 0), np.tile([1.0, 2.0, 3.0], (90, 1)), [[40.0, 40.0, 40.0], [-60.0, 0.0, 0.0]]])
    ids = rng.permutation(len(x)) * 3
    rows = [(int(i), *map(float, v), "x") for i, v in zip(ids, x)]
    rows += rows[:40] + [(90001, None, 1.0, 1.0, "x"), (90002, float("nan"), 1.0, 1.0, "x"), (90003, 9000.0, 1.0, 1.0, "x"), (90004, float("inf"), 1.0, 1.0, "x"), (None, 1.0, 1.0, 1.0, "x")]
    df = spark.createDataFrame(rows, "row_id long, `x_t` double, `x_t-1` double, x0 double, members string").repartition(6)
    lists = knn.nearest(df, "row_id", ["x_t", "x_t-1", "x0"], 5, 9000.0, block=64)
    got = {}
    for r in knn.neighbour_rows(lists, 5).collect():
        got.setdefault(r.id, []).append((r.rank, r.neighbour))
    d = ((x[:, None, :] - x[None, :, :]) ** 2)
    d = d[:, :, 0] + d[:, :, 1] + d[:, :, 2]
    want = {}
    for i in range(len(x)):
        o = [j for j in np.lexsort((ids, d[i])) if j != i][:5]
        want[int(ids[i])] = [(k + 1, int(ids[j])) for k, j in enumerate(o)]
    same = {}
    for v, i in sorted(zip(map(tuple, x), ids), key=lambda p: p[1]):
        same.setdefault(v, []).append(int(i))
    assert got.keys() == {i for s in same.values() for i in s[:6]} and len(got) < len(want)
    assert all(sorted(got[k]) == want[k] for k in got)
    every = {}
    for r in knn.neighbours_of(df, lists, "row_id", ["x_t", "x_t-1", "x0"], 5).collect():
        every.setdefault(r.id, []).append((r.rank, r.neighbour))
    assert {k: sorted(v) for k, v in every.items()} == want
    pairs = {(a, b) for a, w in want.items() for _, b in w if a < b and any(n == a for _, n in want[b])} | {(b, a) for a, w in want.items() for _, b in w if b < a and any(n == a for _, n in want[b])}
    assert {tuple(r) for r in knn.mutual(lists, 5).collect()} == pairs


def test_nearest_small_tables(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, -0.0)], "id long, a double, b double")
    assert sorted((r.id, r.neighbour) for r in knn.neighbour_rows(knn.nearest(df, "id", ["a", "b"], 5), 5).collect()) == [(1, 2), (2, 1)]
    assert knn.nearest(df.limit(0), "id", ["a", "b"], 5).count() == 0
    assert knn.neighbour_rows(knn.nearest(df.limit(1), "id", ["a", "b"], 5), 5).count() == 0


def test_fewer_collisions_still_find_nine_tenths(spark):
    """In many dimensions windows may be narrowed: recall against brute force."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1200, 12)) @ rng.normal(size=(12, 12))
    cols = [f"c{i}" for i in range(12)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=cols).assign(id=np.arange(1200)))
    got = {}
    for r in knn.neighbour_rows(knn.nearest(df, "id", cols, 5, projections=16, width=0.6, threshold=14, block=2048), 5).collect():
        got.setdefault(r.id, set()).add(r.neighbour)
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    hit = sum(len(got.get(i, set()) & set(np.argsort(d[i])[:5].tolist())) for i in range(1200))
    assert hit / 6000 >= 0.9
    assert len(list(itertools.islice(got, 5))) == 5


@pytest.mark.parametrize("latent", [6, 64])
def test_recall_over_many_blocks_in_64_dimensions(spark, latent):
    """Narrower windows, also for the blocks they touch: recall against brute force."""
    rng = np.random.default_rng(latent)
    n, dims = 2500, 64
    x = rng.normal(size=(n, latent)) @ rng.normal(size=(latent, dims)) + rng.normal(0, 0.1, (n, dims))
    cols = [f"c{i}" for i in range(dims)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=cols).assign(id=np.arange(n)))
    lists = knn.nearest(df, "id", cols, 5, width=0.3, threshold=56, block=256)
    got = {}
    for r in knn.neighbour_rows(lists, 5).collect():
        got.setdefault(r.id, set()).add(r.neighbour)
    d = (x**2).sum(axis=1)[:, None] + (x**2).sum(axis=1)[None] - 2 * x @ x.T
    np.fill_diagonal(d, np.inf)
    hit = sum(len(got.get(i, set()) & set(np.argsort(d[i])[:5].tolist())) for i in range(n))
    assert hit / (5 * n) >= 0.9


def test_a_count_against_the_threshold_loses_nothing():
    """Vectors within the reach fall into enough windows, in every number of dimensions."""
    rng = np.random.default_rng(1)
    for dims in (1, 2, 3, 5, 8, 9, 20):
        m, width, threshold = knn.counting(dims)
        x = rng.normal(size=(400, dims))
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        x[: 2 * dims] = np.vstack([np.eye(dims), knn.directions(dims, m, 3)[-dims:]])[: 2 * dims]
        hits = (np.abs(knn.projected(x, knn.directions(dims, m, 3))) <= width * (1 + 1e-9)).sum(axis=1)
        assert hits.min() >= threshold and (dims == 1 or threshold < m)


def test_trees_are_grafted():
    rng = np.random.default_rng(5)
    p = rng.normal(size=(4000, 3))
    axis, at = knn.fitted_blocks(p, 2, 3)
    b = knn.block_of(p, axis, at)
    below = {leaf: knn.fitted_blocks(p[b == leaf], 3, 3) for leaf in (0, 1, 3)}
    got = knn.block_of(p, *knn.grafted(axis, at, below, 3))
    want = np.array([8 * leaf + (knn.block_of(x[None], *below[leaf])[0] if leaf in below else 0) for leaf, x in zip(b, p)])
    assert (got == want).all() and len(set(got)) == 25 and np.bincount(got[b != 2]).max() < 200


def test_many_visitors_of_a_block_are_split(spark, monkeypatch):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(600), "a": rng.normal(size=600), "b": rng.normal(size=600)}))
    want = {tuple(r) for r in knn.neighbour_rows(knn.nearest(df, "id", ["a", "b"], 3, block=2048), 3).collect()}
    monkeypatch.setattr(knn, "VISITORS", 10)
    assert {tuple(r) for r in knn.neighbour_rows(knn.nearest(df, "id", ["a", "b"], 3, block=40), 3).collect()} == want
