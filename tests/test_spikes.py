import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from tidelag.operators import spikes
from tidelag.operators.spikes import Rule


def by_definition(v, rule, begin=None):
    """Cases of one source by the rules' words, one reading at a time.

    Without ``begin`` repeated from no spike at all, else one step from these cases: cases that agree with the
    definition, which speaks of itself, come back unchanged.
    """
    n = len(v)
    fixed = set()
    i = 0
    while i < n:
        j = i
        while j + 1 < n and v[j + 1] == v[i]:
            j += 1
        if j - i + 1 >= 6 and not (rule.zero_runs and v[i] == 0):
            fixed |= set(range(i, j + 1))
        i = j + 1
    fixed |= {i for i in range(n) if v[i] < rule.low or v[i] > rule.high}

    def apart(group, out):
        lo = [k for k in range(group[0] - 1, -1, -1) if k not in out][:5]
        hi = [k for k in range(group[-1] + 1, n) if k not in out][:5]
        if len(lo) < 3 or len(hi) < 3:
            return False
        w = [v[k] for k in lo + hi]
        for k in group:
            if rule.ratio:
                ok = v[k] > rule.ratio * max(w) or v[k] * rule.ratio < min(w)
            else:
                span = rule.width * (max(w) - min(w))
                ok = v[k] > max(w) + span or v[k] < min(w) - span
            if not ok:
                return False
        return True

    out = set(fixed) if begin is None else set(begin)
    for _ in range(30 if begin is None else 1):
        now = set()
        for i in range(n):
            if i in fixed:
                continue
            if apart([i], out - {i}):
                now.add(i)
            if i + 1 < n and i + 1 not in fixed and apart([i, i + 1], out - {i, i + 1}):
                now |= {i, i + 1}
        runs, cur = [], []
        for i in sorted(now):
            if cur and i == cur[-1] + 1:
                cur.append(i)
            else:
                runs.append(cur)
                cur = [i]
        runs.append(cur)
        now = {i for r in runs if len(r) <= 2 for i in r}
        if fixed | now == out:
            return out
        out = fixed | now
    return None if begin is None else out


def series(rng, n, ratio):
    if ratio:
        v = np.round(100 * np.exp(np.cumsum(rng.normal(0, 0.1, n))), 2)
    else:
        v = np.round(rng.normal(0, 1, n), 4)
    for _ in range(n // 25):
        i = int(rng.integers(0, n))
        k = int(rng.integers(1, 3))
        v[i : i + k] = v[i : i + k] * (40 if ratio else 1) + (0 if ratio else 60)
    if n > 40:
        i = int(rng.integers(0, n - 12))
        v[i : i + int(rng.integers(4, 11))] = v[i]
        v[int(rng.integers(0, n))] = -1e6
    return v


@pytest.mark.parametrize("ratio", [5.0, None])
def test_judged_like_the_definition(ratio):
    rule = Rule(ratio=ratio, low=0.0 if ratio else -5000.0, high=9e6 if ratio else 5000.0, zero_runs=bool(ratio), suspect=-1.0)
    rng = np.random.default_rng(3)
    for _ in range(25):
        parts = [series(rng, int(rng.integers(1, 150)), ratio) for _ in range(3)]
        v = np.concatenate(parts)
        start = np.zeros(len(v), bool)
        start[np.cumsum([0, *map(len, parts)])[:-1]] = True
        kind, _, _ = spikes.judged(v, start, np.zeros(len(v), int), [rule])
        at = 0
        for p in parts:
            got = set(np.flatnonzero(kind[at : at + len(p)]).tolist())
            least = by_definition(list(p), rule)
            assert by_definition(list(p), rule, got) == got
            assert least is None or least <= got
            at += len(p)


def test_charts_lose_no_case():
    rng = np.random.default_rng(5)
    for ratio in (5.0, None):
        v = np.concatenate([series(rng, 400, ratio) for _ in range(10)])
        start = np.arange(len(v)) % 400 == 0
        rules = [Rule(ratio=ratio, low=-1e5, suspect=s) for s in (0.5, -1.0)]
        a, b = (spikes.judged(v, start, np.zeros(len(v), int), [r])[0] for r in rules)
        assert (a == b).all() and (a > 0).any()


def cut_up(rows, cuts, rule):
    """Cases found where a table is cut at these rows."""
    found = []
    for a, b in zip([0, *cuts], [*cuts, len(rows)]):
        t = pa.Table.from_pandas(rows.iloc[a:b], preserve_index=False)
        found += [x.to_pandas() for x in spikes._scan([rule])(iter(t.to_batches(max_chunksize=100)))]
    found = pd.concat(found)
    got = found["id"][found["edge"] == 0].tolist()
    for key, g in found[found["edge"] > 0].groupby("src"):
        got += spikes._beside([rule])((0, key), g)["id"].tolist()
    return got


def laid_out(parts):
    rows = pd.DataFrame([(0, f"s{k}", t, 10_000 * k + t, x) for k, p in enumerate(parts) for t, x in enumerate(p)], columns=["w", "src", "t", "id", "v"]).astype({"w": "int32"})
    return rows, (rows["src"] != rows["src"].shift()).to_numpy()


@pytest.mark.parametrize("ratio", [5.0, None])
def test_cuts_of_a_source_change_nothing(monkeypatch, ratio):
    """Readings beside a cut are decided as if there was none, wherever the cuts fall; small limits make many cuts."""
    for name, x in (("CHUNK", 400), ("MEMORY", 6), ("START", 4), ("REPEATS", 3), ("DECIDE", 6 + 27 * 3)):
        monkeypatch.setattr(spikes, name, x)
    rule = Rule(ratio=ratio, low=0.0 if ratio else -5000.0, high=9e6 if ratio else 5000.0, zero_runs=bool(ratio))
    rng = np.random.default_rng(11)
    for trial in range(30):
        parts = [series(rng, int(rng.integers(5, 1500)), ratio) for _ in range(3)]
        if trial % 3 == 0:
            parts[1][20:900] = 7.0
        if trial % 4 == 1:  # runs of one value from the first reading on, longer than a chunk
            parts[0] = np.concatenate([np.full(int(rng.integers(1, 900)), 3.0), parts[0], np.full(700, 5.0), parts[0][:40]])
        if trial % 5 == 2:  # impossible ones and dry seasons
            parts[2][10:300:2] = -1e6
            parts[2][400:480] = 0.0
        if trial % 5 == 3:
            parts[2][50:700] = -np.arange(1e6, 1e6 + 650)[: len(parts[2][50:700])]
        rows, start = laid_out(parts)
        want = set(rows["id"][spikes.judged(rows["v"].to_numpy(), start, rows["w"].to_numpy(), [rule])[0] > 0])
        cuts = sorted(random.Random(trial).sample(range(1, len(rows)), min(4, len(rows) - 1)))
        assert sorted(cut_up(rows, cuts, rule)) == sorted(want)


@pytest.mark.parametrize("ratio", [5.0, None])
def test_cuts_of_long_sources_change_nothing(ratio):
    """The limits and rules that are used, and sources with many faults."""
    rule = Rule(ratio=ratio, low=0.0 if ratio else -5000.0, high=9e6 if ratio else 5000.0, zero_runs=bool(ratio))
    rng = np.random.default_rng(12)
    for trial in range(12):
        rows, start = laid_out([series(rng, 6000, ratio)])
        want = rows["id"][spikes.judged(rows["v"].to_numpy(), start, rows["w"].to_numpy(), [rule])[0] > 0].tolist()
        assert len(want) > 100
        assert sorted(cut_up(rows, [2000 + 37 * trial, 4000 - 53 * trial], rule)) == want


def test_charts_know_only_what_is_near():
    rng = np.random.default_rng(6)
    for _ in range(8):
        v = series(rng, 900, None)
        one = lambda x: (x, np.zeros(len(x)), np.full(len(x), 0.15), np.full(len(x), 2.5))
        whole, part = spikes.chart(*one(v)), spikes.chart(*one(v[300:700]))
        m = spikes.MEMORY
        assert (whole[300 + m : 700 - m] == part[m:-m]).all()
        spike = v.copy()
        spike[450] = 1e6
        assert spikes.chart(*one(spike))[450] > 1000


def test_chart_by_hand():
    """One value at a time."""
    rng = np.random.default_rng(8)
    v = np.round(rng.normal(size=90), 3)
    seg = np.repeat([0, 1, 2], [50, 1, 39])
    got = spikes.chart(v, seg, np.full(90, 0.15), np.full(90, 2.5))
    for i in range(90):
        want = 0.0
        for near in (np.flatnonzero((seg == seg[i]) & (np.arange(90) < i))[-spikes.MEMORY :], np.flatnonzero((seg == seg[i]) & (np.arange(90) > i))[: spikes.MEMORY][::-1]):
            if len(near):
                head = v[near[: spikes.START]]
                mean = np.median(head)
                tiny = 1e-9 + 1e-6 * abs(mean)
                scale = max(1.4826 * np.median(np.abs(head - mean)), tiny)
                for x in v[near]:
                    off = min(max(x - mean, -2.5 * scale), 2.5 * scale)
                    mean, scale = mean + 0.15 * off, max(scale + 0.15 * (1.2533 * abs(off) - scale), tiny)
                want = max(want, abs(v[i] - mean) / scale)
        assert got[i] == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize("sizes,parts", [((30_000, 40, 9_000), 5), ((60, 3, 45), 9), ((12_000,), 3), ((2_500, 2_500), 7)])
def test_flagged_over_partitions(spark, sizes, parts):
    """Sources over many partitions, whole partitions beside a cut, and sources that end at one."""
    rng = np.random.default_rng(sum(sizes))
    rows, start = laid_out([series(rng, n, None) for n in sizes])
    rows["id"] = np.arange(len(rows)) * 7
    rule = Rule(low=-5000.0, high=5000.0)
    want = rows["id"][spikes.judged(rows["v"].to_numpy(), start, rows["w"].to_numpy(), [rule])[0] > 0].tolist()
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
        df = spark.createDataFrame(rows[["id", "src", "t", "v"]]).repartition(3)
        got = [r.reading_id for r in spikes.flagged({"t": (df, "src", "t", "id", "v", rule)}).collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted(got) == want


def test_flagged_edge_cases(spark):
    ok = [(i, "a", i, float(i % 3), "x") for i in range(30)]
    rows = [*ok, (12, "a", 12, 0.0, "again"), (100, "a", 15, None, "x"), (101, "a", None, 5e9, "x"), (102, "a", 16, float("nan"), "x"), (103, None, 1, 9999.0, "x"), (104, "b", 1, float("inf"), "x"), (105, "a", 40, 50_000.0, "x")]
    df = spark.createDataFrame(rows, "rid long, s string, at int, value double, kind string")
    rule = Rule(low=-5000.0, high=5000.0)
    got = {(r.table_name, r.reading_id): r for r in spikes.flagged({"t": (df, "s", "at", "rid", "value", rule)}).collect()}
    assert set(got) == {("t", 103), ("t", 104), ("t", 105)}
    assert {r.kind for r in got.values()} == {"impossible"}
    assert spikes.flagged({"t": (df.limit(0), "s", "at", "rid", "value", rule)}).count() == 0


def test_every_reading_is_examined(monkeypatch):
    """A spike that the charts hold for ordinary."""
    v = np.array([50.0, 51.0, 50.5, 51.5, 50.2, 51.2, 90.0, 50.1, 51.1, 50.6, 51.4, 50.3])
    monkeypatch.setattr(spikes, "chart", lambda x, *_: np.zeros(len(x)))
    kind, _, _ = spikes.judged(v, np.arange(len(v)) == 0, np.zeros(len(v), int), [Rule()])
    assert np.flatnonzero(kind).tolist() == [6] and kind[6] == spikes.SPIKE
