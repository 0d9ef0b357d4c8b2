import base64
import random

import numpy as np
import pytest

from tidelag.llm import bpe, mix, spans

pytestmark = pytest.mark.skipif(not __import__("os").path.exists(bpe.BYTE_BPE_50K), reason="no vocabulary files")
ODD = ["", " ", "a", "é", "é", "​‍", "\r\n\n\t ", "<|endoftext|>", "can't WE'LL", "1234567 ½ ①", "\U0001f469‍\U0001f680" * 3, "中文 текст עברית", "�\x00\x07", "a" * 5000, " " * 3000, "ab" * 2500, "x" * 70 + " y"]


def test_encodes_like_the_public_library_and_back(spark):
    tiktoken = pytest.importorskip("tiktoken")
    with open(bpe.BYTE_BPE_50K, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    ref = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("aAeé 1\n'.中\U0001f600tshn") for _ in range(rng.randint(1, 400))) for _ in range(150)]
    rows = [(i, t, 5, [1]) for i, t in enumerate(texts)] + [(900, None, 5, None), (0, "", 5, [])]
    df = spark.createDataFrame(rows, "doc_id long, text string, k int, ids array<int>")
    got = bpe.encoded(df)
    assert got.columns == ["doc_id", "ids"]
    ids = {r.doc_id: r.ids for r in got.collect()}
    assert got.count() == len(rows)
    assert all(ids[i] == ref.encode_ordinary(t) for i, t in enumerate(texts))
    assert ids[900] == []
    back = {r.doc_id: r.text for r in bpe.decoded(got).collect()}
    assert all(back[i] == t for i, t in enumerate(texts)) and back[900] == ""
    counts = {r.doc_id: r.n_tokens for r in bpe.token_counts(df, ["doc_id"]).collect()}
    assert all(counts[i] == len(ids[i]) for i in ids)
    assert bpe.encoded(df.limit(0)).count() == 0


def docs_and_targets(spark, n=3000):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        s = rng.choices(["big", "mid", "small", "other", None], [60, 25, 5, 5, 5])[0]
        rows.append((i, s, None if i % 97 == 0 else "word " * int(rng.paretovariate(1.2) * 4 % 400), 1, "w"))
    d = spark.createDataFrame(rows, "doc_id long, source string, text string, t int, weight string")
    t = spark.createDataFrame([("big", 0.3, 1), ("mid", 0.4, 3), ("small", 0.2, 2), ("absent", 0.1, 4), ("mid", 0.9, 9)], "source string, weight double, max_repeats int")
    return d, t


def test_mix_shares_and_repeats(spark):
    d, t = docs_and_targets(spark)
    chosen, report = mix.mix(d, t)
    rep = {r.source: r for r in report.collect()}
    assert set(rep) == {"big", "mid", "small", "absent"}
    rows = chosen.collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    total = sum(r.own_tokens for r in rep.values())
    for s, r in rep.items():
        got = [x for x in rows if x.source == s]
        assert r.mix_tokens == sum(x.n_tokens * x.copies for x in got)
        assert max([x.copies for x in got], default=0) <= r.max_repeats
        assert r.falls_short == (r.max_repeats * r.own_tokens < r.weight * total)
        if r.falls_short:
            assert r.mix_tokens == r.max_repeats * r.own_tokens
        else:
            assert abs(r.mix_tokens - r.weight * total) < 0.03 * total
    assert not rep["big"].falls_short and rep["small"].falls_short and rep["absent"].falls_short
    assert abs(sum(r.share for r in rep.values()) - 1) < 1e-4
    again = mix.mix(d.repartition(9), t)[0]
    assert sorted(again.collect()) == sorted(rows)
    assert sorted(mix.mix(d, t, seed=8)[0].collect()) != sorted(rows)


def test_mix_inclusion_follows_size(spark):
    """Records of each size come in the mix as often as their inclusion probability says."""
    rng = np.random.default_rng(0)
    size = rng.integers(1, 60, 6000)
    d = spark.createDataFrame([(i, "s", "word" + " word" * int(k - 1)) for i, k in enumerate(size)], "doc_id long, source string, text string")
    size = np.array([r.n_tokens for r in bpe.token_counts(d, ["doc_id"]).orderBy("doc_id").collect()])
    t = spark.createDataFrame([("s", 1.0, 3)], "source string, weight double, max_repeats int")
    rest = 0.7 * float(size.sum())
    lo, hi = 0.0, 1.0
    for _ in range(60):
        c = (lo + hi) / 2
        lo, hi = (c, hi) if (size * np.minimum(1, c * size)).sum() < rest else (lo, c)
    p = np.minimum(1, c * size)
    n = np.zeros(6000)
    for r in mix.mix(d, t, seed=1, total=rest + size.sum())[0].collect():
        n[r.doc_id] = r.copies - 1
    assert set(n) == {0, 1} and n.sum() == round(p.sum()) and (n[p > 0.999] == 1).all()
    for k in range(0, 60, 10):
        some = (size > k) & (size <= k + 10)
        assert abs(n[some].mean() - p[some].mean()) < 0.05


def test_mix_empty(spark):
    d, t = docs_and_targets(spark, 5)
    a, b = mix.mix(d.limit(0), t)
    assert a.count() == 0 and b.count() == 4
    a, b = mix.mix(d, t.limit(0))
    assert a.count() == 0 and b.count() == 0


def windows(texts, least):
    where = {}
    for k, x in texts:
        for i in range(len(x or "") - least + 1):
            where.setdefault(x[i : i + least], set()).add(k)
    out = {}
    for k, x in texts:
        for i in range(len(x or "") - least + 1):
            if len(where[x[i : i + least]]) > 1:
                out.setdefault(k, set()).update(range(i, i + least))
    return out


@pytest.mark.parametrize("least,few,longest", [(12, 1 << 19, 1 << 20), (40, 1 << 19, 1 << 20), (40, 0, 37)])
def test_shared_spans_equal_all_windows(spark, monkeypatch, least, few, longest):
    monkeypatch.setattr(spans, "FEW_KEYS", few)
    monkeypatch.setattr(spans, "LONGEST", longest)
    rng = random.Random(least)
    texts = []
    for al in ("ab", "abcdef ", "the quick brown fox é\U0001f600中"):
        base = ["".join(rng.choice(al) for _ in range(rng.randint(1, 150))) for _ in range(6)]
        base += ["z" * rng.randint(20, 90), "q" + "z" * 60 + "q", "xy" * 40]
        for _ in range(25):
            texts.append("".join(b[rng.randint(0, len(b)) :][: rng.randint(1, 90)] for b in rng.choices(base, k=rng.randint(1, 4))))
    one = "unique text that repeats inside itself only. " * 4
    rows = [(i, x) for i, x in enumerate(texts)] + [(900, None), (901, ""), (902, "short"), (903, one), (904, "n" * 4000), (905, "m" + "n" * 3000)]
    df = spark.createDataFrame([(*r, 1, "s") for r in rows] + [(3, texts[3], 1, "s")], "doc_id long, text string, k int, x string").repartition(5)
    got = {}
    for r in spans.shared_spans(df, least=least).collect():
        assert not got.setdefault(r.doc_id, set()) & set(range(r.start, r.stop))
        got[r.doc_id] |= set(range(r.start, r.stop))
    want = windows(rows, least)
    assert got == want and 903 not in got and len(want[904]) == 4000
    share = {r.doc_id: (r.n_chars, r.shared_chars) for r in spans.shared_share(df, least=least).collect()}
    assert share == {k: (len(x or ""), len(want.get(k, ()))) for k, x in rows}
    assert spans.shared_spans(df.limit(0), least=least).count() == 0


def test_equal_windows_have_equal_keys():
    rng = random.Random(2)
    for _ in range(60):
        least, rounds = rng.choice([6, 20, 40]), rng.choice([1, 3, 6])
        al = rng.choice(["ab", "abcd", "abcdefghijklmnop "])
        base = ["".join(rng.choice(al) for _ in range(rng.randint(30, 120))) for _ in range(4)] + ["a" * 70]
        texts = ["".join(b[rng.randint(0, len(b)) :][: rng.randint(1, 80)] for b in rng.choices(base, k=3)) for _ in range(8)]
        of, x0, x1, key = spans.ranges(texts, least, rounds)
        seen, count = {}, 0
        for o, a, b, k in zip(of, x0, x1, key):
            for x in range(a, b + 1):
                count += 1
                assert seen.setdefault(texts[o][x : x + least], k) == k
        assert count == sum(max(0, len(t) - least + 1) for t in texts)


@pytest.mark.parametrize("ids", [(1, 2), (2, 1)])
def test_span_of_one_record_meets_the_others_of_its_key(spark, ids):
    """A record that holds both a span of two records and a span of its own with the same key."""
    rng = random.Random(8)
    for least in (12, 140):
        p = "".join(rng.choice("abcdefgh ") for _ in range(3 * least))
        rows = list(zip(ids, (p + p + p, p)))
        df = spark.createDataFrame(rows, "doc_id long, text string")
        share = {r.doc_id: r.shared_chars for r in spans.shared_share(df, least=least).collect()}
        want = windows(rows, least)
        assert share == {k: len(want[k]) for k in ids} == {ids[0]: 3 * len(p), ids[1]: len(p)}
        got = {r.doc_id: (r.start, r.stop) for r in spans.shared_spans(df, least=least).collect()}
        assert got == {ids[0]: (0, 3 * len(p)), ids[1]: (0, len(p))}


def test_thue_morse_records_are_told_apart(spark):
    """Polynomials modulo a power of two can't tell such texts from each other."""
    def morse(bits, swap):
        t = [0]
        for _ in range(bits):
            t += [1 - x for x in t]
        return "".join("ab"[x ^ swap] for x in t)

    rows = []
    for bits in (10, 11, 12):
        rows += [(bits * 10 + swap, "<" * 200 + str(bits) * 3 + morse(bits, swap) + ">") for swap in (0, 1)]
    texts = dict(rows)
    df = spark.createDataFrame([(k, v) for k, v in rows], "doc_id long, text string")
    for least in (1024, 140):
        got = {}
        for r in spans.shared_spans(df, least=least).collect():
            got.setdefault(r.doc_id, set()).update(range(r.start, r.stop))
        for k, t in texts.items():
            want = set()
            for x in range(len(t) - least + 1):
                if any(t[x : x + least] in o for j, o in texts.items() if j != k):
                    want |= set(range(x, x + least))
            assert got.get(k, set()) == want


def test_digests_are_of_the_texts_themselves():
    texts = ["abc😀def", "é" * 40, "abc😀def"]
    code, _, begin = spans._codes(texts)
    h = spans.digests(code.tobytes(), begin[:-1], begin[1:])
    assert (h[0] == h[2]).all() and not (h[0] == h[1]).all()
    assert (spans.digests(code.tobytes(), begin[:1] + 1, begin[:1] + 4) == spans.digests(code.tobytes(), begin[2:3] + 1, begin[2:3] + 4)).all()
