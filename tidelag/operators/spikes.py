"""Implausible readings of many sources: robust control charts, run-length counters, physical limits."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelag.shared import number, quoted, ship, written

#: Rows of a task that are worked on at once.
CHUNK = 1 << 18
#: Readings that a chart runs over before the one it judges, those of its start, and readings charted at once.
MEMORY, START, CHARTED = 32, 12, 1 << 14
#: Times that the rule is applied.
REPEATS = 12
NEAR, LEAST, RUN = 5, 3, 6
SPIKE, STUCK, IMPOSSIBLE = 1, 2, 3
KINDS = {SPIKE: "spike", STUCK: "stuck", IMPOSSIBLE: "impossible"}
#: Ordinary readings (neither impossible nor of a run, three in a row at least) from a cut within which a reading may
#: depend on what lies beyond it: at least one in five of them is no case, so each repetition looks at 5 NEAR and a pair at
#: most. Those this near to a cut are decided from both sides of it, and as many again are passed on for that.
DECIDE = MEMORY + (5 * NEAR + 2) * REPEATS


@dataclass(frozen=True)
class Rule:
    """What counts as implausible for one quantity.

    ``ratio``: a spike is more than so many times the largest, or less than the so-manieth part of the smallest,
    reading around; if None it lies outside their range by more than ``width`` times the range's width.
    ``low``, ``high``: physical limits. ``zero_runs``: runs of zero are genuine.
    ``rate``, ``clip``: weight of a new reading in the chart, and deviations (in scales) beyond which it is clipped.
    ``suspect``, ``strong``: deviations from which a reading is examined (every reading if negative), and from which it
    isn't used to judge others until it has been cleared.
    """

    ratio: float | None = None
    width: float = 2.0
    low: float = -np.inf
    high: float = np.inf
    zero_runs: bool = False
    rate: float = 0.15
    clip: float = 2.5
    suspect: float = -1.0
    strong: float = 3.0


def chart(x: np.ndarray, seg: np.ndarray, rate: np.ndarray, clip: np.ndarray) -> np.ndarray:
    """Largest deviation, in scales, of each value from the exponentially weighted charts run forwards and backwards.

    ``seg`` numbers the sources. The chart of a value runs over the MEMORY values before it (behind it, for the other): it
    starts from the median and the median deviation of the first START of them, and each value is clipped to ``clip``
    scales before it moves the mean and the scale. What lies farther away has no part in it, wherever the
    table is cut. A value without others of its source on a side deviates by 0 there.
    """
    n = len(x)
    out = np.zeros(n)
    pad = np.full(MEMORY, np.nan)
    for way in (1, -1):
        v, g = (np.concatenate([pad, x[::way]]), np.concatenate([np.full(MEMORY, -1), seg[::way]]))
        windows, owners = (np.lib.stride_tricks.sliding_window_view(z, MEMORY) for z in (v, g))
        r, c = rate[::way], clip[::way]
        for lo in range(0, n, CHARTED):
            part = slice(lo, min(n, lo + CHARTED))
            own = g[MEMORY:][part]
            w = np.where(owners[part] == own[:, None], windows[part], np.nan).T.copy()
            there = np.isfinite(w)
            first = np.where(there.any(axis=0), there.argmax(axis=0), MEMORY)
            some = first[None] + np.arange(START)[:, None]
            head = np.where(some < MEMORY, np.take_along_axis(w, np.minimum(some, MEMORY - 1), 0), np.nan)
            m = np.minimum(START, MEMORY - first)
            at = np.arange(w.shape[1])

            def centre(h: np.ndarray) -> np.ndarray:
                h = np.sort(h, axis=0)  # missing ones last
                return (h[np.maximum(m - 1, 0) // 2, at] + h[np.minimum(m // 2, np.maximum(m - 1, 0)), at]) / 2

            mean = centre(head)
            with np.errstate(invalid="ignore"):
                tiny = 1e-9 + 1e-6 * np.abs(mean)
                scale = np.maximum(1.4826 * centre(np.abs(head - mean)), tiny)
                rr, cc = r[part], c[part]
                for t in range(MEMORY):
                    off = w[t] - mean
                    lim = cc * scale
                    off = np.where(there[t], np.minimum(np.maximum(off, -lim), lim), 0.0)
                    mean = mean + rr * off
                    scale = np.where(there[t], np.maximum(scale + rr * (1.2533 * np.abs(off) - scale), tiny), scale)
                z = np.abs(v[MEMORY:][part] - mean) / scale
            z = np.where(np.isnan(z), 0.0, z)
            target = out[::way][part]
            np.maximum(target, z, out=target)
    return out


def judged(v: np.ndarray, start: np.ndarray, which: np.ndarray, rules: list[Rule]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kind (0: plausible), chart deviation and run length of each reading.

    ``v`` are readings in time order, source after source, ``start`` marks the first of each source and
    ``which`` its rule. A reading is a spike if it, or it and the one beside it, stands apart from the five
    readings before and the five after that are themselves plausible (three at least on either side). The rule speaks
    of its own answer and is applied REPEATS times, first without what the charts hold for suspect. What still changes
    then counts if the last two answers hold it. An answer depends on readings within DECIDE only.
    """
    n = len(v)
    kind = np.zeros(n, np.int8)
    if not n:
        return kind, np.zeros(0), np.zeros(0, np.int64)
    get = lambda f: np.array([f(r) for r in rules])[which]
    new = start.copy()
    new[1:] |= v[1:] != v[:-1]
    run = np.cumsum(new) - 1
    length = np.bincount(run)[run]
    kind[(length >= RUN) & ~((v == 0) & get(lambda r: r.zero_runs))] = STUCK
    kind[(v < get(lambda r: r.low)) | (v > get(lambda r: r.high))] = IMPOSSIBLE
    fixed = kind > 0
    ratio = get(lambda r: r.ratio or 0.0)
    by_ratio = ratio > 0
    x = np.where(by_ratio, np.log(np.maximum(v, 0) + 1e-3), v)
    seg = np.cumsum(start)
    z = np.zeros(n)
    free = np.flatnonzero(~fixed)
    z[free] = chart(x[free], seg[free], get(lambda r: r.rate)[free], get(lambda r: r.clip)[free])
    suspect = get(lambda r: r.suspect)
    asked = np.flatnonzero(((suspect < 0) | (z >= suspect)) & ~fixed)
    times, widths = ratio[asked], get(lambda r: r.width)[asked]

    def at_most_two(flag: np.ndarray) -> np.ndarray:
        edge = start.copy()
        edge[1:] |= flag[1:] != flag[:-1]
        r = np.cumsum(edge) - 1
        return flag & (np.bincount(r)[r] <= 2)

    def apart(out: np.ndarray, pair: bool) -> np.ndarray:
        """Of the asked: apart from its surroundings without ``out`` and itself, or (pair) it and the next one."""
        left = ~out
        g = np.flatnonzero(left)
        vg, sg = np.append(v[g], 0.0), np.append(seg[g], -1)
        pos = np.cumsum(left) - left
        p = pos[asked]
        after = p + left[asked]
        usable = np.ones(len(asked), bool)
        if pair:
            nxt = np.minimum(asked + 1, n - 1)
            usable = ~fixed[nxt] & (seg[nxt] == seg[asked]) & (asked + 1 < n)
            after = after + left[nxt]
        s = seg[asked]
        hi, lo = np.full(len(asked), -np.inf), np.full(len(asked), np.inf)
        count = []
        for side in (-1, 1):
            got = np.zeros(len(asked), np.int8)
            for j in range(NEAR):
                k = p - 1 - j if side < 0 else after + j
                ok = (k >= 0) & (k < len(g))
                k = np.where(ok, k, len(g))
                ok &= sg[k] == s
                val = vg[k]
                hi = np.where(ok, np.maximum(hi, val), hi)
                lo = np.where(ok, np.minimum(lo, val), lo)
                got += ok
            count.append(got)
        usable &= (count[0] >= LEAST) & (count[1] >= LEAST)

        def far(val: np.ndarray) -> np.ndarray:
            with np.errstate(invalid="ignore"):
                span = widths * (hi - lo)
                return np.where(times > 0, (val > times * hi) | (val * times < lo), (val > hi + span) | (val < lo - span))

        usable &= far(v[asked])
        if pair:
            usable &= far(v[nxt])
        return usable

    out = fixed | at_most_two((z >= get(lambda r: r.strong)) & ~fixed)
    before = spike = np.zeros(n, bool)
    for _ in range(REPEATS):
        before, spike = spike, np.zeros(n, bool)
        spike[asked[apart(out, False)]] = True
        two = asked[apart(out, True)]
        spike[two] = True
        spike[two + 1] = True
        spike = at_most_two(spike & ~fixed)
        following = fixed | spike
        if (following == out).all():
            before = spike
            break
        out = following
    spike = spike & before
    kind[spike] = SPIKE
    return kind, z, length


def _scan(rules: list[Rule]):
    """Over a partition sorted by source and time: cases (edge 0), and readings beside its two ends (edge 1 to 4).

    A source longer than a chunk is worked through with the last readings of one chunk as the context of the next.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = told = 0
        head_open = True
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= CHUNK:
                t = pa.Table.from_batches(held).combine_chunks()
                start = _starts(t)
                cut = int(np.flatnonzero(start)[-1])
                rest: list[tuple[pa.Table, int, bool]] = []
                if cut == 0:  # one source fills the chunk and may go on
                    yield from _work(t, start, rules, told, head_open, False, rest)
                else:
                    yield from _work(t.slice(0, cut), start[:cut], rules, told, head_open, False)
                    rest = [(t.slice(cut), 0, False)]
                left, told, head_open = rest[0]
                held, rows = left.to_batches(), left.num_rows
        if rows:
            t = pa.Table.from_batches(held).combine_chunks()
            yield from _work(t, _starts(t), rules, told, head_open, True)

    return run


def _starts(t: pa.Table) -> np.ndarray:
    """Marks rows whose source differs from that of the row before."""
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for c in ("w", "src"):
        codes = t[c].combine_chunks()
        codes = codes.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False) if c == "src" else codes.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return new


def _work(t: pa.Table, start: np.ndarray, rules: list[Rule], told: int, head_open: bool, tail_open: bool, rest: list | None = None) -> Iterator[pa.RecordBatch]:
    """Judges a chunk, of which the first ``told`` rows are context only.

    ``head_open``, ``tail_open``: the first or last source may have rows in another partition. With ``rest`` the last
    source goes on in this partition: its last readings are left undecided and put there, after their context.
    """
    ids = t["id"].to_numpy()
    again = np.zeros(t.num_rows, bool)
    again[1:] = (ids[1:] == ids[:-1]) & ~start[1:]
    if again.any():
        keep = np.flatnonzero(~again)
        told -= int(again[:told].sum())
        t, start, ids = t.take(pa.array(keep)), start[keep], ids[keep]
    v, which = t["v"].to_numpy(), t["w"].to_numpy()
    kind, z, length = judged(v, start, which, rules)
    n = len(v)
    pending, passed, gap, behind = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool)
    pending[:told] = True  # told before
    if n and (head_open or tail_open or rest is not None):
        # a run of one value, or of impossible ones, tells by its first and last MEMORY readings; the others are decided anyway
        new = start.copy()
        odd = np.array([(r.low, r.high) for r in rules])[which]
        odd = (v < odd[:, 0]) | (v > odd[:, 1])
        new[1:] |= (v[1:] != v[:-1]) & ~(odd[1:] & odd[:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        last_of = np.append(np.flatnonzero(new)[1:], n) - 1
        last = last_of[np.cumsum(new) - 1]
        at = np.arange(n)
        told_by = (at - first < max(MEMORY, RUN)) | (last - at < max(MEMORY, RUN))
        ordinary = ~odd & (last - first < RUN - 1)
        turn = start.copy()
        turn[1:] |= ordinary[1:] != ordinary[:-1]
        stretch = np.cumsum(turn) - 1
        ordinary &= np.bincount(stretch)[stretch] >= 3
        bounds = np.append(np.flatnonzero(start), n)

        def reached(rows: np.ndarray, many: int) -> int:
            """How many rows from the cut hold so many ordinary ones beyond the run that touches the cut."""
            c = np.cumsum(ordinary[rows] & (first[rows] != first[rows[0]]))
            return int(np.searchsorted(c, many, "left")) + 1 if len(c) and c[-1] >= many else len(rows)

        h = np.arange(bounds[-2], n)
        tail = h[told_by[h]][::-1]
        if rest is not None and head_open and reached(tail, 3 * DECIDE) == len(tail):
            # hardly anything but runs of one value: all that may matter to the rows before is kept for the next chunk
            rest.append((t.take(pa.array(tail[::-1])), 0, True))
            pending[tail] = True
            head_open, rest = False, None
        if head_open:
            h = np.arange(bounds[1])
            head = h[told_by[h]]
            pending[head[: reached(head, DECIDE)]] = passed[head[: reached(head, 2 * DECIDE)]] = True
        if tail_open:
            far = reached(tail, 2 * DECIDE)
            passed[tail[:far]] = behind[tail[:far]] = True
            if len(tail) > far and not passed[tail[far]]:
                gap[tail[far - 1]] = True
        if rest is not None:
            kept = np.sort(tail[: reached(tail, 3 * DECIDE)])
            rest.append((t.take(pa.array(kept)), max(0, len(kept) - reached(tail, DECIDE)), False))
        if tail_open or rest is not None:
            pending[tail[: reached(tail, DECIDE)]] = True
    case = (kind > 0) & ~pending
    open_ = pending.copy()
    open_[:told] = False
    for mask, edge in ((case, False), (passed, True)):
        at = np.flatnonzero(mask)
        if len(at):
            s = t.take(pa.array(at))
            e = np.where(open_[at], 2, 1) + 2 * gap[at] if edge else np.zeros(len(at), np.int64)
            cols = [s[c].combine_chunks() for c in ("w", "src", "t", "id", "v")]
            more = [kind[at].astype(np.int32), z[at], length[at].astype(np.int64), e.astype(np.int32), behind[at].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([*cols, *map(pa.array, more)], names=["w", "src", "t", "id", "v", "kind", "z", "run", "edge", "behind"])


def _beside(rules: list[Rule]):
    """Decides the readings beside a cut of a source from all that was passed on of it."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "id", "v"], kind="stable").drop_duplicates(["t", "id"]).reset_index(drop=True)
        start = (pdf["edge"] > 2).to_numpy().copy()
        start[:1] = True
        kind, z, length = judged(pdf["v"].to_numpy(), start, pdf["w"].to_numpy(), rules)
        pdf["kind"], pdf["z"], pdf["run"] = kind.astype(np.int32), z, length
        return pdf[(kind > 0) & (pdf["edge"] % 2 == 0)].drop(columns="cut", errors="ignore")

    return run


def _numbered(scan):
    """A scan that puts the number of the partition beside each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in scan(batches):
            pid = pa.array(np.full(b.num_rows, TaskContext.get().partitionId(), np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns, pid], names=[*b.schema.names, "pid"])

    return run


def _by_cut(edges: DataFrame) -> DataFrame:
    """Adds the number of the cut that a reading passed on lies beside.

    Of the partitions, a row each comes to the driver. A partition that lies within one source and is passed on whole
    joins the cuts on its two sides.
    """
    one = edges.groupBy("pid").agg(((F.min(F.struct("w", "src")) == F.max(F.struct("w", "src"))) & (F.max("edge") <= 2)).alias("whole"))
    cut, rows = 0, []
    for r in sorted(one.collect()):
        before = cut
        cut += 0 if r["whole"] else 1
        rows.append((r["pid"], before, cut))
    places = edges.sparkSession.createDataFrame(rows, "pid int, head int, tail int")
    return edges.join(F.broadcast(places), "pid").withColumn("cut", F.when(F.col("behind") == 1, F.col("tail")).otherwise(F.col("head"))).drop("head", "tail")


def flagged(tables: Mapping[str, tuple[DataFrame, str, str, str, str, Rule]]) -> DataFrame:
    """Implausible readings of every source of every table.

    :param tables: name -> (table, source column, time column, reading id column, value column, rule). Times are
        whole numbers (cast to BIGINT) or timestamps (taken in microseconds), ids whole numbers.
    :returns: table_name, source, reading_id, value, kind ('spike', 'stuck', 'impossible'), deviation (largest,
        in scales, from the source's control charts) and run_length (equal readings in a row; near a cut of a
        very long source up to its first and last MEMORY readings are counted), a row for each implausible reading.

    Readings whose value or time is missing are left out beforehand; infinite values are kept and judged. A null
    source is a source of its own. Rows of one source that repeat a reading id count once (with equal times;
    the least value counts). Equal times are ordered by id. Empty tables give no rows. Other columns are dropped.

    Rows are laid out by ranges of (source, time), so that a source of any length is spread over many tasks. Only the
    readings beside either end of a partition (2 DECIDE, and the ends of the runs among them) meet again, by cut, to be
    judged with both sides at hand. The rows put out are the same wherever the cuts fall.
    """
    rules = [r for *_, r in tables.values()]
    names = list(tables)
    parts = []
    for k, (df, source, time, key, value, _) in enumerate(tables.values()):
        ship(df.sparkSession)
        t = F.unix_micros(quoted(time)) if df.schema[time].dataType.typeName() == "timestamp" else quoted(time).cast("bigint")
        parts.append(df.select(F.lit(k).alias("w"), quoted(source).cast("string").alias("src"), t.alias("t"), quoted(key).cast("bigint").alias("id"), number(quoted(value)).alias("v")).where("v IS NOT NULL AND t IS NOT NULL"))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionAll(p)
    order = ["w", "src", "t", "id", "v"]
    schema = "w int, src string, t bigint, id bigint, v double, kind int, z double, run bigint, edge int, behind int"
    first = written(rows.repartitionByRange(*order[:4]).sortWithinPartitions(*order).mapInArrow(_numbered(_scan(rules)), f"{schema}, pid int"))

    beside = _by_cut(first.where("edge > 0")).drop("pid").groupBy("w", "src", "cut").applyInPandas(_beside(rules), schema)
    first = first.drop("pid")
    name = F.element_at(F.array(*map(F.lit, names)), F.col("w") + 1)
    what = F.element_at(F.array(*(F.lit(KINDS[i]) for i in (1, 2, 3))), F.col("kind"))
    return first.where("edge = 0").unionAll(beside).select(name.alias("table_name"), F.col("src").alias("source"), F.col("id").alias("reading_id"), F.col("v").alias("value"), what.alias("kind"), F.col("z").alias("deviation"), F.col("run").alias("run_length"))
