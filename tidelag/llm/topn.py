"""Top N rows of every group by mergeable bounded heaps."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelag.shared import number, quoted, ship

#: Rows gathered before the heaps of a task are trimmed, and kept rows beyond which they are passed on.
GATHER, KEEP = 1 << 18, 1 << 18


def trimmed(t: pa.Table, groups: list[str], ties: list[str], n: int) -> tuple[pa.Table, np.ndarray]:
    """The n best distinct rows of each group, sorted, and the place of each in its group."""
    t = t.group_by([*groups, *ties], use_threads=False).aggregate([("s", "max")]).rename_columns([*groups, *ties, "s"])
    t = t.take(pc.sort_indices(t, sort_keys=[*((g, "ascending") for g in groups), ("s", "descending"), *((x, "ascending") for x in ties)]))
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for g in groups:
        codes = t[g].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    at = np.arange(t.num_rows)
    place = at - np.maximum.accumulate(np.where(new, at, 0))
    keep = place < n
    return t.filter(pa.array(keep)), place[keep]


def _joined(batches: list[pa.RecordBatch]) -> pa.Table:
    names = batches[0].schema.names
    return pa.concat_tables([pa.Table.from_arrays([b.column(c) for c in names], names=names) for b in batches])


def _partial(groups: list[str], ties: list[str], n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        full = least = None
        for b in batches:
            if full is not None and len(full):
                at = pc.index_in(b.column(groups[0]), value_set=full)
                b = b.filter(pc.fill_null(pc.greater_equal(b.column("s"), pc.take(least, at)), True))
            held.append(b)
            rows += b.num_rows
            if rows >= GATHER:
                t, place = trimmed(_joined(held), groups, ties, n)
                if t.num_rows > KEEP // 2:  # too many groups to be worth keeping: pass them on, they merge later
                    yield from t.combine_chunks().to_batches()
                    held, rows, full = [], 0, None
                    continue
                held, rows = t.to_batches(), t.num_rows
                if len(groups) == 1:
                    last = t.filter(pa.array(place == n - 1))
                    last = last.filter(pc.is_valid(last[groups[0]]))
                    full, least = last[groups[0]].combine_chunks(), last["s"].combine_chunks()
        if rows:
            yield from trimmed(_joined(held), groups, ties, n)[0].combine_chunks().to_batches()

    return run


def _merge(groups: list[str], ties: list[str], n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        names = [*groups, *ties, "s", "place"]
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= GATHER // 2:
                # the partition is sorted by group, so only the last group read may go on: its heap is kept
                tail = held[-1].slice(held[-1].num_rows - 1)
                t = _joined(held)
                same = np.ones(t.num_rows, bool)
                for g in groups:
                    v = tail.column(g)[0]
                    same &= pc.is_null(t[g]).to_numpy() if not v.is_valid else pc.fill_null(pc.equal(t[g], v), False).to_numpy()
                done, place = trimmed(t.filter(pa.array(~same)), groups, ties, n)
                yield from done.append_column("place", pa.array(place.astype(np.int64))).rename_columns(names).combine_chunks().to_batches()
                kept, _ = trimmed(t.filter(pa.array(same)), groups, ties, n)
                held, rows = kept.to_batches(), kept.num_rows
        if rows:
            t, place = trimmed(_joined(held), groups, ties, n)
            yield from t.append_column("place", pa.array(place.astype(np.int64))).rename_columns(names).combine_chunks().to_batches()

    return run


def top_n(df: DataFrame, group: str | Sequence[str], score: str, ties: Sequence[str], n: int = 5) -> DataFrame:
    """The ``n`` rows with the highest ``score`` of every group.

    Each task keeps a heap of at most ``n`` rows per group before the shuffle; the shuffle carries
    those heaps only and they are merged afterwards, so a group of any size is never gathered.

    :param group: column or columns that name the group; a null group is a group of its own.
    :param score: numeric column; rows whose score is null or NaN don't count, infinite ones do.
    :param ties: columns that with the group identify a row; they settle equal scores in ascending
        order (strings by bytes, nulls last). Rows equal in group and ties count once, with their best score.
    :returns: group, ties, score and ``place`` (BIGINT, 1 is best), in no order. Other columns are dropped.
        An empty table gives an empty result. Raises ValueError if ``n`` is below 1 or ``ties`` is empty.
    """
    if n < 1 or not ties:
        raise ValueError("n must be positive and ties must name at least one column")
    ship(df.sparkSession)
    group = [group] if isinstance(group, str) else list(group)
    g, t = [f"g{i}" for i in range(len(group))], [f"t{i}" for i in range(len(ties))]
    rows = df.select(*(quoted(c).alias(a) for a, c in zip([*g, *t], [*group, *ties])), number(quoted(score)).alias("s")).where("s is not null")
    kept = rows.mapInArrow(_partial(g, t, n), rows.schema)
    merged = kept.repartition(*g).sortWithinPartitions(*g).mapInArrow(_merge(g, t, n), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", place bigint")
    return merged.select(*(F.col(a).alias(c) for a, c in zip([*g, *t, "s"], [*group, *ties, score])), (F.col("place") + 1).alias("place"))
