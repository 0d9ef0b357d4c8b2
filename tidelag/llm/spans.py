"""Long exact spans shared between records, found by recompression.

Every text is parsed in rounds: equal symbols in a row are named as one (runs), then neighbours whose
names fall on the left and the right side of a split of the alphabet are named as one (pairs). A name is
derived from what it stands for, by the same function everywhere, so all records share one global naming
without an exchange of tables, and equal substrings get equal symbols except near their ends. Along with every symbol
its context is kept: the stretch of text that alone decides that this symbol stands there. A window of text
thus has a key, the symbols whose context lies inside it, that equal windows share wherever they occur.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelag.shared import quoted, ship, written

U = np.uint64
ROUNDS = 9
#: Code points of the texts that are parsed at once.
TOGETHER = 1 << 16
#: Multipliers that spread pairs and runs before they are mixed.
SPREAD = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), 0x632BE59BD9B4E019)
#: Bytes of the digests by which texts are compared.
DIGEST = 16
#: Keys, and spans of them, up to which those of several records are sent to every task; more are joined by a shuffle.
FEW_KEYS = 1 << 18
#: Stretches that a task puts out at once.
ROWS_OUT = 1 << 16
#: Windows of a text that are parsed at once; a longer text is parsed in parts. As only what lies inside a window is in its
#: key, the parts give the keys of the whole.
LONGEST = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Name of every code point."""
    return mixed(np.arange(1, 0x110001, dtype=U))


def named(a: np.ndarray, b: np.ndarray, what: int) -> np.ndarray:
    """Name of a pair (what even) or a run (what odd) in the round what // 2."""
    return mixed(a * SPREAD[0] + b * SPREAD[1] + U(SPREAD[2] * (what + 1) & (1 << 64) - 1))


def parse(code: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, ...]:
    """Symbols of texts laid end to end: name, first and last position, context's first and last position, text.

    ``code`` are code points and ``doc`` the number of each one's text. A context that is bounded by an end
    of the text reaches beyond it by one: no window holds it.
    """
    n = len(code)
    name = letters()[code]
    e = np.arange(n, dtype=np.int32)
    cs, ce = e.copy(), e.copy()
    # symbols tile the texts: one begins where the one before ends
    edge = np.ones(n, bool)  # first of its text
    edge[1:] = doc[1:] != doc[:-1]

    def begins(e: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(min(1, len(e)), np.int32), e[:-1] + np.int32(1)])

    for r in range(rounds):
        for runs in (True, False):
            m = len(name)
            if m < 2:
                break
            inner = ~edge[1:]
            s = begins(e)
            if runs:
                # a symbol's fate depends on the neighbours on both sides: on one code point of a neighbour that is seen to
                # differ by its own first or last, else on all that decides the neighbour's name
                np.minimum(cs, s - np.int32(1), out=cs)
                np.maximum(ce, e + np.int32(1), out=ce)
                last, first = code[e], code[s]
                alike = np.flatnonzero(inner & (last[1:] == last[:-1]))
                back = np.flatnonzero(inner & (first[1:] == first[:-1]))
                lo, hi = cs[alike].copy(), ce[alike].copy()
                lo_, hi_ = cs[back + 1].copy(), ce[back + 1].copy()
                cs[alike + 1] = np.minimum(cs[alike + 1], lo)
                ce[alike + 1] = np.maximum(ce[alike + 1], hi)
                cs[back] = np.minimum(cs[back], lo_)
                ce[back] = np.maximum(ce[back], hi_)
                join = inner & (name[1:] == name[:-1])
                if not join.any():
                    continue
            else:
                # names are spread evenly, so each round takes another of their bits
                left = (name >> U(r + 7)) & U(1) == 0
                join = inner & left[:-1] & ~left[1:]
                # a left one may only join the next, a right one only the one before, and depends on all that decides it
                a = np.flatnonzero(inner & left[:-1])
                b = np.flatnonzero(inner & ~left[1:])
                lo, hi, lo_, hi_ = cs[a + 1], ce[a + 1], cs[b], ce[b]
                out_left, out_right = s - np.int32(1), e + np.int32(1)
                lonely = np.flatnonzero(left & np.append(edge[1:], True))
                ce[lonely] = np.maximum(ce[lonely], out_right[lonely])
                lonely = np.flatnonzero(~left & edge)
                cs[lonely] = np.minimum(cs[lonely], out_left[lonely])
                cs[a] = np.minimum(cs[a], lo)
                ce[a] = np.maximum(ce[a], hi)
                cs[b + 1] = np.minimum(cs[b + 1], lo_)
                ce[b + 1] = np.maximum(ce[b + 1], hi_)
            head = np.append(True, ~join)
            at = np.flatnonzero(head)
            size = np.diff(np.append(at, m))
            big = np.flatnonzero(size > 1)
            tail = at + size - 1
            new, ncs, nce = name[at], cs[at], ce[at]
            if runs:
                new[big] = named(name[at[big]], size[big].astype(U), 2 * r + 1)
                member = np.flatnonzero(np.repeat(size > 1, size))
                cut = np.cumsum(size[big]) - size[big]
                ncs[big], nce[big] = np.minimum.reduceat(cs[member], cut), np.maximum.reduceat(ce[member], cut)
            else:
                x = at[big]
                new[big] = named(name[x], name[x + 1], 2 * r)
                ncs[big], nce[big] = np.minimum(cs[x], cs[x + 1]), np.maximum(ce[x], ce[x + 1])
            name, e, edge, cs, ce = new, e[tail], edge[at], ncs, nce
    s = begins(e)
    return name, s, e, cs, ce, doc[s] if len(s) else np.zeros(0, np.int64)


def digests(text: bytes, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """128-bit BLAKE2b digests, as two numbers each, of the code points lo to hi of a text of four bytes a code point."""
    whole = memoryview(text)
    got = b"".join([blake2b(whole[a:b], digest_size=DIGEST).digest() for a, b in zip((4 * lo).tolist(), (4 * hi).tolist())])
    return np.frombuffer(got, np.int64).reshape(-1, 2)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the texts end to end, the text of each, and where each text begins (and the end)."""
    each = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    size = np.array([len(x) for x in each], np.int64)
    return np.concatenate(each) if each else np.zeros(0, np.uint32), np.repeat(np.arange(len(each)), size), np.append(0, np.cumsum(size))


def ranges(texts: list[str], least: int, rounds: int = ROUNDS) -> tuple[np.ndarray, ...]:
    """Stretches of windows (of ``least`` code points) with one key: text, first and last start, key.

    The key of a window stands for the symbols whose context lies inside it.
    """
    code, doc, begin = _codes(texts)
    name, s, e, cs, ce, d = parse(code, doc, rounds)
    # contexts in terms of windows: the symbol is in the key of the windows that start in [ce-least+1, cs]
    size = np.diff(begin)
    windows = size - least + 1
    lo_w, hi_w = np.maximum(ce - least + 1, begin[d]), np.minimum(cs, begin[d] + windows[d] - 1)
    ok = (lo_w <= hi_w) & (cs >= begin[d]) & (ce < begin[d + 1])
    name, s, lo_w, hi_w, d = name[ok], s[ok], lo_w[ok], hi_w[ok], d[ok]
    # the key is the sum of what each of its symbols adds, relative to the window's first symbol; as symbols may
    # come and go in any order, it is kept as a sum of hashed names
    value = mixed(name)
    has = np.flatnonzero(windows > 0)
    at = np.concatenate([lo_w, hi_w + 1, begin[has], (begin[has] + windows[has])])
    add = np.concatenate([value, U(0) - value, np.zeros(2 * len(has), U)])
    of = np.concatenate([d, d, has, has])
    order = np.argsort(at + of, kind="stable")  # texts lie one after the other
    at, add, of = at[order], np.cumsum(add[order], dtype=U), of[order]
    lead = np.append((at[1:] != at[:-1]) | (of[1:] != of[:-1]), True) if len(at) else np.zeros(0, bool)
    at, add, of = at[lead], add[lead], of[lead]
    same = of[1:] == of[:-1]
    x0, x1, key, of = at[:-1][same], at[1:][same] - 1, add[:-1][same], of[:-1][same]
    return of, x0 - begin[of], x1 - begin[of], mixed(key).view(np.int64)


def _batched(b: pa.RecordBatch, text: str) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Rows of a batch by parts of about TOGETHER code points."""
    x = b.column(text).to_pylist()
    lo = total = 0
    for i, t in enumerate(x):
        total += len(t)
        if total >= TOGETHER or i == len(x) - 1:
            yield np.arange(lo, i + 1), x[lo : i + 1]
            lo, total = i + 1, 0


def shared_spans(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = 140, rounds: int = ROUNDS) -> DataFrame:
    """Stretches of every record's text that belong to a verbatim match of ``least`` code points with another record.

    :returns: ``key``, ``start`` and ``stop`` (code points, from 0, stop exclusive), merged so that the stretches of a
        record are disjoint. Every window of ``least`` code points that also stands in another record is covered,
        and nothing else. Texts are compared as they are, whole; null texts and texts shorter than ``least`` have no row. A
        repeat inside one record does not count. Rows that repeat a key (and its text) are one record. An empty table gives no rows; a row without a key can't
        be told and is left out.

    No pair of records is formed and no group is gathered: windows meet by their keys and digests, which are
    counted before the shuffle. Keys of one record only are dropped first. A stretch of windows with one key is settled at once where the whole span stands in
    two records; only where a key stands in several records with different spans are single windows compared.
    """
    if least < 1:
        raise ValueError("least must be positive")
    ship(df.sparkSession)
    docs = df.select(quoted(key).alias("k"), quoted(text).cast("string").alias("x")).where(F.col("k").isNotNull() & (F.length("x") >= least))
    kind = docs.schema["k"].dataType.simpleString()

    longest = LONGEST

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: list[tuple[np.ndarray, ...]] = []
            many = 0

            def put() -> pa.RecordBatch:
                at, w, x0, x1 = (np.concatenate(z) for z in zip(*held))
                held.clear()
                return pa.RecordBatch.from_arrays([b.column("k").take(pa.array(at)), pa.array(w), pa.array(x0.astype(np.int32)), pa.array(x1.astype(np.int32))], names=["k", "w", "x0", "x1"])

            for rows, texts in _batched(b, "x"):
                parts_ = [(i, lo) for i, x in enumerate(texts) for lo in range(0, max(1, len(x) - least + 1), longest)]
                of, x0, x1, w = ranges([texts[i][lo : lo + longest + least - 1] for i, lo in parts_], least, rounds)
                text_of, begins = np.array(parts_, np.int64).T
                held.append((rows[text_of[of]], w, x0 + begins[of], x1 + begins[of]))
                many += len(of)
                if many >= ROWS_OUT:
                    yield put()
                    many = 0
            if held:
                yield put()

    # most keys stand in one record only and are gone after this
    parts = written(docs.mapInArrow(scan, f"k {kind}, w bigint, x0 int, x1 int"))
    met_keys = parts.groupBy("w").agg(F.min("k").alias("a"), F.max("k").alias("b")).where("a <> b").select("w")
    met_keys = written(met_keys)
    chosen = parts.join(F.broadcast(met_keys) if met_keys.count() <= FEW_KEYS else met_keys, "w", "left_semi")

    def per_record(rows: DataFrame) -> DataFrame:
        """Texts of the records of these stretches, with the stretches (as many as the text has at most)."""
        return docs.join(rows.groupBy("k").agg(F.collect_list(F.struct("w", "x0", "x1")).alias("r")), "k")

    def stretches(b: pa.RecordBatch, rows: np.ndarray, texts: list[str]):
        """The texts' code points, where each text begins, and text, key, first and last start of its stretches."""
        code, _, begin = _codes(texts)
        lists = b.column("r").take(pa.array(rows))
        flat = lists.flatten()
        of = np.repeat(np.arange(len(rows)), np.diff(lists.offsets.to_numpy()))
        w, x0, x1 = (flat.field(i).to_numpy().astype(np.int64) for i in range(3))
        return code.tobytes(), begin, of, w, x0, x1

    def whole_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, texts in _batched(b, "x"):
                code, begin, of, w, x0, x1 = stretches(b, rows, texts)
                h = digests(code, x0 + begin[of], x1 + begin[of] + least).T
                yield pa.RecordBatch.from_arrays([b.column("k").take(pa.array(rows[of])), pa.array(w), *(pa.array(np.ascontiguousarray(z)) for z in h), pa.array(x0.astype(np.int32)), pa.array(x1.astype(np.int32))], names=["k", "w", "h0", "h1", "x0", "x1"])

    # what all windows of a stretch cover, its span, is compared first
    parts = written(per_record(chosen).mapInArrow(whole_spans, f"k {kind}, w bigint, h0 bigint, h1 bigint, x0 int, x1 int"))
    spans = written(parts.groupBy("w", "h0", "h1").agg(F.min("k").alias("a"), F.max("k").alias("b")))
    few = F.broadcast if spans.count() <= FEW_KEYS else lambda x: x
    keys = spans.groupBy("w").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.max((F.col("a") == F.col("b")).cast("int")).alias("single"))
    whole = spans.where("a <> b").select("w", "h0", "h1")
    settled = parts.join(few(whole), ["w", "h0", "h1"], "left_semi").select("k", "x0", "x1")
    open_keys = keys.where("a <> b AND single = 1").select("w")
    # of each span of an open key the least and the greatest record stand for all, as one of them is another record than
    # any that is asked; the others of a span that is in two records are settled
    stands = spans.join(few(open_keys), "w", "left_semi").select("w", "h0", "h1", F.explode(F.array_distinct(F.array("a", "b"))).alias("k"))
    asked = parts.join(few(stands), ["w", "h0", "h1", "k"], "left_semi").select("k", "w", "x0", "x1")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, texts in _batched(b, "x"):
                code, begin, of, w, x0, x1 = stretches(b, rows, texts)
                n = x1 - x0 + 1
                for lo in range(0, len(n), 1 << 14):
                    part = slice(lo, lo + (1 << 14))
                    m = n[part]
                    total = int(m.sum())
                    x = np.arange(total) - np.repeat(np.cumsum(m) - m, m) + np.repeat(x0[part], m)
                    d = np.repeat(of[part], m)
                    h = digests(code, x + begin[d], x + begin[d] + least).T
                    yield pa.RecordBatch.from_arrays([b.column("k").take(pa.array(rows[d])), *(pa.array(np.ascontiguousarray(z)) for z in h), pa.array(x.astype(np.int32))], names=["k", "h0", "h1", "x"])

    single = written(per_record(asked).mapInArrow(windows, f"k {kind}, h0 bigint, h1 bigint, x int"))
    twice = single.groupBy("h0", "h1").agg(F.min("k").alias("a"), F.max("k").alias("b")).where("a <> b").select("h0", "h1")
    met = single.join(twice, ["h0", "h1"], "left_semi").select("k", F.col("x").alias("x0"), F.col("x").alias("x1"))
    every = settled.unionAll(met).select("k", F.col("x0").alias("s"), (F.col("x1") + least).alias("e"))
    order = Window.partitionBy("k").orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = every.withColumn("new", F.when(F.col("s") <= reach, 0).otherwise(1)).withColumn("i", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return islands.groupBy("k", "i").agg(F.min("s").alias("start"), F.max("e").alias("stop")).select(F.col("k").alias(key), "start", "stop")


def shared_share(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = 140) -> DataFrame:
    """``key``, ``n_chars``, ``shared_chars`` and ``share`` of every record: how much of it is shared elsewhere.

    Null and empty texts have 0 characters and share 0.
    """
    spans = shared_spans(df, key, text, least).groupBy(key).agg(F.sum(F.col("stop") - F.col("start")).alias("s"))
    all_ = df.groupBy(quoted(key).alias("k")).agg(F.max(F.coalesce(F.length(quoted(text)), F.lit(0))).cast("bigint").alias("n_chars"))
    out = all_.join(spans.withColumnRenamed(key, "k"), "k", "left").withColumn("shared_chars", F.coalesce("s", F.lit(0)).cast("bigint"))
    return out.select(F.col("k").alias(key), "n_chars", "shared_chars", F.when(F.col("n_chars") > 0, F.round(F.col("shared_chars") / F.col("n_chars"), 6)).otherwise(0.0).alias("share"))
