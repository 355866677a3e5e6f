"""Operators 11 to 13 against brute force, the tokenizers library and exact round trips."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import fill_middle, spelling, token_files

DOCS = "doc_id long, text string, n long, form string, root string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 0, "clash", "clash") for d, t in rows], DOCS)


# spelling variants


def brute_variants(rows, letters=6, occurrences=5, times=5, damaged=199):
    seen = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % damaged == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    words = {w: n for w, n in seen.items() if len(w) >= letters and n >= occurrences}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out, form = {}, {}
    for w, n in words.items():
        others = [x for x in words if near(w, x)]
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= times * n else None
        out[w] = [len(others), words[best] if form[w] else None]
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, words[w], *out[w])
    return out


def variant_docs(seed=3):
    rng = random.Random(seed)
    base = ["".join(rng.choices("abcdeÀéÿß÷", k=rng.randint(5, 9))) for _ in range(25)] + ["Aaaaaab", "aaaaaa", "x" * 70, "y" * 200]
    words = []
    for w in base:
        words += [w] * rng.choice([30, 60, 200])
        for _ in range(6):  # variants, and variants of variants
            i = rng.randrange(len(w))
            v = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abcdé") + w[i:], w[:i] + rng.choice("abcdeé") + w[i + 1 :]])
            words += [v] * rng.choice([3, 5, 6, 30])
            if rng.random() < 0.4:
                w = v
    rng.shuffle(words)
    rows = [(i // 7, " Ā".join(words[i : i + 7])) for i in range(0, len(words), 7)]
    return [*rows, (None, " ".join(words[:50])), (None, None), (5, ""), (5, "1 2 3 ×÷"), rows[0], rows[0]]


@pytest.mark.parametrize("limit", [1 << 20, 4096])
def test_variants_equal_brute_force(spark, limit):
    rows = variant_docs()
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(frame(spark, rows), damaged=7, limit=limit).collect()}
    want = brute_variants(rows, damaged=7)
    assert got == want
    assert any(w[0] and w[0] != w[1] for w in want.values()), "chains of forms"
    assert {w for w in want if len(w) > 63}


def test_variants_on_documents(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.op11_spelling_variants(spark, sf_dir).collect()}
    assert got == brute_variants(rows)


def test_variants_of_nothing(spark):
    assert spelling.variants(frame(spark, [])).collect() == []
    assert spelling.variants(frame(spark, [(1, None), (2, "")])).collect() == []


def test_filters_hold_all_words_in_every_split():
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefgh", k=8)) for _ in range(3000)]
    for limit in (4096, 1 << 20):
        passes = spelling.passes_of({8: len(words)}, limit)
        assert len(passes) > 1 or limit > 4096
        raw = spelling.raw_hashes(spelling.letters_of(words))
        found = set()
        for blocks in passes:
            total, low, high = blocks[8]
            block, h = spelling.bits_of(raw, total)
            lanes = np.zeros((-(-(high - low) // spelling.ROW_BLOCKS) * spelling.ROW_BLOCKS, spelling.LANES), np.uint32)
            mine = (block >= low) & (block < high)
            for lane in range(spelling.LANES):
                np.bitwise_or.at(lanes, (block[mine] - low, lane), np.uint32(1) << spelling.lane_bit(h[mine], lane).astype(np.uint32))
            filters = spelling.Filters(blocks, [(8, p, lanes[p * 128 : (p + 1) * 128].tobytes()) for p in range(len(lanes) // 128)])
            found |= set(filters.may_hold(8, raw).tolist())
            other = spelling.raw_hashes(spelling.letters_of(["".join(rng.choices("ijkl", k=8)) for _ in range(3000)]))
            assert len(filters.may_hold(8, other)) < 60
        assert len(found) == len(words)


def test_pieces_end_where_runs_do(monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 10)
    text = "abc defghijklmno pq " + "z" * 35 + " é"
    pieces = list(spelling._pieces(text))
    assert "".join(pieces) == text and len(pieces) > 2
    assert sum((re.findall(spelling.RUN, p) for p in pieces), []) == re.findall(spelling.RUN, text)


# token files


def test_code_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(0)
    n = rng.zipf(1.3, 300).astype(np.int64)
    import heapq

    heap = [(int(x), i, [i]) for i, x in enumerate(n)]
    heapq.heapify(heap)
    depth = np.zeros(len(n), np.int64)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        depth[a[2] + b[2]] += 1
        heapq.heappush(heap, (a[0] + b[0], len(n) + a[1], a[2] + b[2]))
    free = token_files.code_lengths(n, 60 if depth.max() > 25 else 25)
    assert (free * n).sum() == (depth * n).sum()
    for limit in (9, 10, 12):
        lengths = token_files.code_lengths(n, limit)
        assert lengths.max() <= limit and sum(2.0**-b for b in lengths) <= 1
        assert (lengths * n).sum() >= (free * n).sum()
    fib = np.array([1, 1, 2, 3, 5, 8, 13, 21])
    assert (token_files.code_lengths(fib, 4) * fib).sum() == min((token_files.code_lengths(fib, 4) * fib).sum(), 8 * 54)
    with pytest.raises(ValueError):
        token_files.code_lengths(np.ones(5, np.int64), 2)
    assert token_files.code_lengths(np.array([7])).tolist() == [1]


@pytest.mark.parametrize("stride", [1, 3, 64])
def test_blocks_come_back(stride, monkeypatch):
    monkeypatch.setattr(token_files, "PIECE_IDS", 100)
    monkeypatch.setattr(token_files, "TOGETHER", 250)
    rng = np.random.default_rng(1)
    n = rng.zipf(1.2, 5000).clip(1, 4000)
    ids, count = np.unique(n, return_counts=True)
    code = token_files.Code(ids, token_files.code_lengths(count, 14), 14)
    docs = [n[a:b] for a, b in ((0, 1), (1, 700), (700, 701), (701, 4000), (4000, 5000))]
    parts = token_files.coded(docs, code, stride)
    marks = sum(len(m) for _, m in parts) // 2
    raw = token_files.pack_block([(f'{{"doc_id":{i}}}', len(d), *p) for i, (d, p) in enumerate(zip(docs, parts))], 77, marks)
    start, names, sizes, back = token_files.unpack_block(raw, code, stride)
    assert start == 77 and len(names) == 5 and sizes == [len(d) for d in docs]
    assert [np.frombuffer(b, "<u4").tolist() for b in back] == [d.tolist() for d in docs]
    with pytest.raises(ValueError):
        token_files.unpack_block(raw[:60] + bytes([raw[60] ^ 1]) + raw[61:], code, stride)


def brute_tokens(rows):
    pt = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(pt.path("word_bpe_49k.json"))
    out, start = [], 0
    for d, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((d, start, len(ids), ids.tobytes()))
        start += len(ids)
    return out


def test_token_files_equal_the_library(spark, tmp_path):
    rng = random.Random(2)
    text = lambda k: " ".join("".join(rng.choices("abcdefghAB éßΣ中😀'’<|>19", k=rng.randint(1, 9))) for _ in range(k))
    rows = [(i, text(rng.randint(0, 80))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "x<|endoftext|>y <|startoftext|>"), (1004, text(30_000)), (-5, "It's İstanbul ﬁ Σσς é ")]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    path = str(tmp_path / "ids")
    token_files.write(frame(spark, shuffled).repartition(7), path, block_ids=2000)
    got = sorted(token_files.read(spark, path).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in got] == brute_tokens(sorted(rows))
    assert spark.read.parquet(path + "/blocks").count() > 3


def test_token_files_of_repeated_and_null_ids_and_of_nothing(spark, tmp_path):
    rows = [(None, "b"), (3, "same"), (3, "same"), (3, "other words"), (None, "a"), (2, "z")]
    token_files.write(frame(spark, rows), str(tmp_path / "a"))
    got = sorted(token_files.read(spark, str(tmp_path / "a")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, 2, 3, 3, 3]
    ends = [r.start + r.n_tokens for r in got]
    assert [r.start for r in got] == [0, *ends[:-1]]
    want = {bytes(i) for _, _, _, i in brute_tokens(rows)}
    assert {bytes(r.ids) for r in got} == want and sorted(r.n_tokens for r in got) == sorted(n for _, _, n, _ in brute_tokens(rows))
    token_files.write(frame(spark, []), str(tmp_path / "b"))
    assert token_files.read(spark, str(tmp_path / "b")).collect() == []


def test_op12_on_documents(spark, sf_dir):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    got = sorted(tuple(r) for r in token_files.op12_token_files(spark, sf_dir).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == [(d, s, n, zlib.crc32(i)) for d, s, n, i in brute_tokens(rows)]


# fill in middle


def units(text):
    return re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)


@pytest.mark.parametrize("piece", [7, 1 << 20])
def test_rank_index_is_exact(piece, monkeypatch):
    monkeypatch.setattr(fill_middle, "PIECE", piece)
    rng = random.Random(5)
    texts = ["", "a", "é", "abc", "a b", "x" * 5000 + " " * 5000 + "y" * 300, "".join(rng.choice(["word", " ", "longerword" * rng.randint(1, 60), "é", "\n", "中"]) for _ in range(9000))]
    for text in texts:
        index = fill_middle.RankIndex.fit(text)
        ends = np.cumsum([0, *map(len, units(text))])
        assert index.n == len(ends) - 1
        assert [index.offset(k) for k in range(len(ends))] == ends.tolist()
        assert len(index.residuals) == len(ends)
    assert len(fill_middle.RankIndex.fit(texts[5]).firsts) >= 2


def brute_fill(d, text):
    text = text or ""
    u = units(text)
    h = [int(hashlib.sha256(f"1:{'' if d is None else d}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return d, len(u), "plain", None, None, text
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if h[3] % 100 < 20:
        return d, len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return d, len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_middle_equals_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, "".join(rng.choice(["ab", "<", "S", ">", "<P", "M>", "é", " ", "😀", "\n"]) for _ in range(rng.randint(0, 60)))) for i in range(400)]
    rows += [(None, None), (None, "two words"), (7, ""), (7, "x<M>y"), (8, "long words " * 3000), (8, "long words " * 3000)]
    done = fill_middle.restored(fill_middle.fill_middle(frame(spark, rows))).collect()
    want = [brute_fill(*r) for r in rows]
    key = lambda r: repr(r)
    assert sorted((tuple(r)[:6] for r in done), key=key) == sorted(want, key=key)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in done) == sorted((d is None, d or 0, t or "") for d, t in rows)
    assert {r.form for r in done} == {"plain", "psm", "spm"}
    assert fill_middle.fill_middle(frame(spark, [])).count() == 0


def test_stored_index_answers_cuts(spark, tmp_path):
    rows = [(1, "some words, and more"), (2, ""), (3, None), (4, "a" * 700 + " b" * 900)]
    fill_middle.rank_index(frame(spark, rows)).write.parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index")).withColumn("asked", F.array(F.lit(0), F.col("n"), F.col("n") - 1, F.col("n") + 1))
    for r in fill_middle.offsets(index, "asked").collect():
        ends = np.cumsum([0, *map(len, units(dict(rows)[r.doc_id] or ""))]).tolist()
        assert r.offsets == [0, ends[-1], ends[-2] if len(ends) > 1 else None, None]


def test_op13_equals_its_sql(spark, sf_dir, duck):
    from conftest import same

    same(fill_middle.op13_fill_middle(spark, sf_dir), duck, fill_middle.ORACLE)
