import hashlib
import random

import numpy as np
import pytest
from helpers import DOCS, jaccard, sample_docs
from pyspark.sql import functions as F

from corvane.llm import bwt_dedup, graph, jaccard as join, multi_index


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randint(-50, 50), rng.randint(-50, 50)) for _ in range(60)] + [(i, i + 1) for i in range(100, 140)] + [(5, 5)]
    parent = {x: x for p in links for x in p}
    for _ in range(len(parent)):
        for a, b in links:
            parent[a] = parent[b] = min(parent[a], parent[b])
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: v for k, v in parent.items() if k in got} and all(parent[a] == parent[b] for a, b in links)
    assert {a for a, b in links if a != b} <= set(got)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def unit(v):
    return v / np.linalg.norm(v)


def test_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "BLOCK", 16)
    rng = np.random.default_rng(3)
    base = [rng.standard_normal(16) for _ in range(60)]
    rows = [(i, b) for i, b in enumerate(base)]
    for i in range(60, 140):  # near copies of few vectors, at cosines about the threshold
        b = unit(base[int(rng.integers(0, 6))])
        u = rng.standard_normal(16)
        u = unit(u - (u @ b) * b)
        c = rng.uniform(0.85, 1)
        rows.append((i, c * b + np.sqrt(1 - c * c) * u))
    rows += [(200 + i, base[0]) for i in range(40)] + [(300, 2 * base[1])]
    data = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    odd = [(400, None), (401, [0.0] * 16), (402, [float("nan")] + [1.0] * 15), (403, [None] + [1.0] * 15), (404, []), (405, [float("inf")] * 16), (406, [1.0, 2.0]), (407, [1.0, 2.0])]
    df = spark.createDataFrame(data + odd, "vec_id long, embedding array<float>").withColumns({"n_links": F.lit("x"), "copies": F.lit(1)})
    got = {r.vec_id: r for r in multi_index.dedup_vectors(df, recall=1.0).collect()}
    ids = [i for i, _ in data]
    x = np.array([unit(np.array(v)) for _, v in data])
    linked = x @ x.T >= 0.9
    np.fill_diagonal(linked, False)
    label = np.array(ids)[multi_index.forest(*np.nonzero(linked), len(ids))]
    assert [got[i].n_links for i in ids] == linked.sum(1).tolist()
    assert [got[i].component_id for i in ids] == label.tolist()
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(400, 406))
    assert (got[406].n_links, got[407].component_id, got[407].kept) == (1, 406, False) and len(got) == len(data) + len(odd)
    assert multi_index.dedup_vectors(df.limit(0)).count() == 0


def test_vectors_without_ids_and_of_any_scale(spark):
    rows = [(None, [1.0, 2.0]), (None, [1.0, 2.0]), (None, [1.0, 2.1]), (7, [3.0, -1.0]), (3, [3.0, -1.1]), (1, [1e200, -1e200]), (2, [1e200, -1.1e200]), (8, [1e-200, 0.0]), (None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in multi_index.dedup_vectors(df, recall=1.0).collect())
    want = [(0, 0, 0, True), (0, 2, 0, True), (0, 2, 0, True), (0, 2, 0, True)]
    v = {r[0]: np.array(r[1]) / np.linalg.norm(np.array(r[1]) / max(map(abs, r[1]))) / max(map(abs, r[1])) for r in rows if r[0]}
    linked = {a: {b for b in v if a != b and v[a] @ v[b] >= 0.9} for a in v}
    reach = {a: {a} for a in v}
    for _ in v:
        reach = {a: {c for b in reach[a] for c in {b} | linked[b]} for a in v}
    assert got == sorted(want + [(a, len(linked[a]), min(reach[a]), a == min(reach[a])) for a in v])


def test_index_recall_is_high(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((1500, 64))
    x = [unit(b) for b in base]
    for i in range(500):
        u = rng.standard_normal(64)
        u = unit(u - (u @ x[i]) * x[i])
        c = rng.uniform(0.91, 0.99)
        x.append(c * x[i] + np.sqrt(1 - c * c) * u)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = multi_index.dedup_vectors(df).where("vec_id >= 1500")
    assert got.where("n_links >= 1 AND component_id = vec_id - 1500").count() >= 0.95 * 500


def test_links_count_at_both_ends(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "cells_for", lambda *_: 2)
    monkeypatch.setattr(multi_index, "BLOCK", 64)
    rng = np.random.default_rng(6)
    x = [unit(b) for b in rng.standard_normal((1000, 32))]
    for i in range(1000):
        u = rng.standard_normal(32)
        u = unit(u - (u @ x[i]) * x[i])
        x.append(0.92 * x[i] + np.sqrt(1 - 0.92**2) * u)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in multi_index.dedup_vectors(df).collect()}
    met = [got[i][1] == got[i + 1000][1] for i in range(1000)]
    assert 0 < sum(met) < 1000
    assert all(got[i][0] == got[i + 1000][0] == int(m) for i, m in enumerate(met))


def test_partners_at_the_threshold_are_met():
    rng = np.random.default_rng(9)
    x = rng.standard_normal((2000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    books = (multi_index.fit_codebook(x[:, :16], 8), multi_index.fit_codebook(x[:, 16:], 8))
    visits = multi_index.cells_for(x, books, 0.9, 0.99)
    u = rng.standard_normal(x.shape)
    u -= (u * x).sum(1)[:, None] * x
    y = 0.9 * x + np.sqrt(1 - 0.81) * u / np.linalg.norm(u, axis=1)[:, None]
    dx, dy = multi_index.half_distances(x, books), multi_index.half_distances(y, books)
    own = dy[0].argmin(1) * 8 + dy[1].argmin(1)
    met = [c in multi_index.traverse(a, b, visits) for a, b, c in zip(*dx, own.tolist(), strict=True)]
    assert np.mean(met) >= 0.98


def test_vectors_of_all_lengths_are_compared(spark, monkeypatch):
    seen = []

    def search(spark, groups, width, *_):
        seen.append(width)
        return spark.createDataFrame([], "node binary, n long"), spark.createDataFrame([], "a binary, b binary")

    monkeypatch.setattr(multi_index, "_search", search)
    df = spark.createDataFrame([(i, [1.0] * (i + 1)) for i in range(70)], "vec_id long, embedding array<double>")
    multi_index.near_links(df)
    assert sorted(seen) == list(range(1, 71))


def test_traversal_is_in_order_of_distance():
    rng = np.random.default_rng(5)
    a, b = rng.random(9), rng.random(9)
    got = multi_index.traverse(a, b, 81)
    sums = [a[c // 9] + b[c % 9] for c in got]
    assert sorted(got) == list(range(81)) and sums == sorted(sums)


def brute_spans(docs, length):
    seen, out = set(), {}
    for key, t in sorted(docs):
        covered = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            if w in seen:
                covered[i : i + length] = True
            seen.add(w)
        runs = int((np.diff(np.concatenate(([0], covered.astype(int), [0]))) == 1).sum())
        out[key] = (len(t), int(covered.sum()), runs, hashlib.sha256(np.frombuffer(t, np.uint8)[~covered].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("split", [2000, 4])
def test_repeats_equal_brute_force(spark, monkeypatch, split):
    monkeypatch.setattr(bwt_dedup, "TOGETHER", 20)
    monkeypatch.setattr(bwt_dedup, "SPLIT", split)
    monkeypatch.setattr(bwt_dedup, "CHUNK", 700)
    rng = random.Random(6)
    texts = [(r[1] or "").encode() for r in sample_docs(5, 40)]
    for i in range(120):
        base = bytes(rng.choices(b"ab\0", k=rng.randint(0, 400)))
        o, k = rng.choice(texts).decode(errors="ignore").encode(), rng.randint(0, 200)
        texts.append((base[:k] + o[rng.randint(0, 50) :][: rng.randint(50, 300)] + base[:60]).decode(errors="ignore").encode())
    texts += [b"x" * 1000, b"ab" * 2000, "é".encode() * 400, texts[1] * 3]
    docs = list(enumerate(texts))
    rows = [(i, t.decode()) for i, t in docs] + [(500, None), (501, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"doc": F.lit(1), "spans": F.lit("x")}).repartition(5)
    got = {r.doc_id: (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in bwt_dedup.remove_repeats(df).collect()}
    assert got == brute_spans(docs, 100) | {i: (0, 0, 0, hashlib.sha256(b"").hexdigest()) for i in (500, 501)}


def test_repeated_intervals_equal_brute_force():
    rng = random.Random(4)
    base = bytes(rng.choices(b"abc", k=60))
    contexts = [bytes(rng.choices(b"abc", k=rng.randint(0, 9))) + base[rng.randint(0, 9) : rng.randint(30, 60)] + bytes(rng.choices(b"ab", k=rng.randint(0, 9))) for _ in range(14)] + [b"", base, base]
    want = []
    for i, c in enumerate(contexts):
        for end in range(12, len(c) + 1):
            n = max((k for j, d in enumerate(contexts) for e in range(len(d) + 1) if (j, e) != (i, end) for k in [next((k for k in range(min(end, e)) if c[end - 1 - k] != d[e - 1 - k]), min(end, e))]), default=0)
            if n >= 12:
                want.append((i, end - n, n))
    assert bwt_dedup.repeated_intervals(contexts, 12, 3) == sorted(want) and want
    assert bwt_dedup.repeated_intervals([], 12) == []


def test_equal_hashes_of_other_bytes_are_told_apart():
    r = np.zeros(3, bwt_dedup.RECORD)
    r["doc"], r["check"], r["before"] = [1, 2, 3], [5, 6, 5], 3
    own, spans = bwt_dedup.firsts(r)
    assert sorted(own["doc"].tolist()) == [1, 2] and spans["doc"].tolist() == [3]


def test_repeats_of_repeated_rows(spark):
    t, u = "".join(chr(97 + i * i % 23) for i in range(300)), "z" * 50 + "".join(chr(97 + i * i % 19) for i in range(200))
    df = spark.createDataFrame([(1, t), (1, t), (None, u), (2, u), (3, t[:99])], "doc_id long, text string")
    got = sorted((str(r.doc_id), sum(s.end - s.start for s in r.spans)) for r in bwt_dedup.remove_repeats(df).collect())
    inner = brute_spans([(0, t.encode())], 100)[0][1]
    assert got[:2] == [("1", inner), ("1", inner)] and dict(got)["2"] == 250 and dict(got)["3"] == 0
    assert bwt_dedup.remove_repeats(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [4000, 10])
def test_jaccard_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(join, "BLOCK", block)
    monkeypatch.setattr(join, "FREQUENT", 5)
    rng = random.Random(7)
    docs = [(r[0], r[1]) for r in sample_docs(8, 80)]
    core = [rng.choice("abcdefgh") for _ in range(50)]
    for i in range(200, 280):
        w = core[:] if rng.random() < 0.7 else [rng.choice("abcdefgh") for _ in range(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 2)):
            if w:
                w[rng.randrange(len(w))] = rng.choice("abcdefghIJ")
        docs.append((i, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"key": F.lit("x"), "n": F.lit(1)}).repartition(5)
    for size, percent in ((3, 90), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in join.jaccard_groups(df, size, percent).collect()}
        want = jaccard(docs, size, percent)
        assert got == want
    kept = join.one_of_each(df.unionByName(df.limit(9)))
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({v[1] for v in want.values()})


def test_jaccard_odd_rows(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (2, None), (3, ""), (4, "a b"), (5, "A\tb"), (None, "x y z w"), (9, "x y z w")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in join.jaccard_groups(df).collect())
    assert got == sorted([("1", 2, "1"), ("1", 2, "1"), ("2", 0, "2"), ("3", 0, "3"), ("4", 1, "4"), ("5", 1, "4"), ("None", 2, "9"), ("9", 2, "9")])
    assert join.jaccard_groups(df.limit(0)).count() == 0 and join.one_of_each(df.limit(0)).count() == 0


def test_search_of_many_sets_and_shingles():
    """Sets times distinct shingles above 2^31; the links of the large sets as plain sets give them."""
    rng = np.random.default_rng(5)
    base = np.unique(rng.integers(0, 1 << 63, 400_000, dtype=np.uint64))
    more = np.unique(rng.integers(0, 1 << 63, 40_000, dtype=np.uint64))
    near, far = np.union1d(base[12_000:], more[:12_000]), np.union1d(base[:-30_000], more[12_000:])
    tiny = [np.array([x], np.uint64) for x in range(7_000)]
    sets = [base, near, far, *tiny]
    assert len(sets) * len(np.unique(np.concatenate(sets))) > 1 << 31
    asks = np.arange(len(sets)) < 3
    found = join.t_occurrence(np.concatenate(sets), np.array([len(s) for s in sets]), np.arange(len(sets)), asks, 90)
    plain = [set(s.tolist()) for s in sets[:3]]
    want = {(a, b) for a in range(3) for b in range(a + 1, 3) if 100 * len(plain[a] & plain[b]) >= 90 * len(plain[a] | plain[b])}
    assert {tuple(sorted(x)) for x in found} == want == {(0, 1)}
