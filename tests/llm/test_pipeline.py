import struct

import pytest
from helpers import DOCS, jaccard, sample_docs, words
from pyspark.sql import functions as F

import corpus_pipeline
from corvane.llm import mixing


def brute_lines(rows):
    sites, first = {}, {}
    for d, t, _, s, _ in rows:
        for p, x in enumerate(t.split("\n")):
            if y := x.strip(" \t\r"):
                sites.setdefault(y, set()).add(s)
                first[y] = min(first.get(y, (1 << 60, 0)), (d, p))
    wide = {y for y, s in sites.items() if len(s - {None}) >= 5}
    for d, t, lang, s, n in rows:
        kept = [x for p, x in enumerate(t.split("\n")) if x.strip(" \t\r") not in wide or first[x.strip(" \t\r")] == (d, p)]
        out = "\n".join(kept)
        if out == t or words(out):
            yield d, out, lang, s, n if out == t else len(out)


def test_pipeline_equals_brute_force(spark, tmp_path):
    pt = pytest.importorskip("public_tokenizers")
    from test_texts import brute_quality
    from tokenizers import Tokenizer

    rows = sample_docs(9, 90)
    docs = spark.createDataFrame(rows, DOCS).withColumn("size", F.lit("clash"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    good = []
    for r in rows:
        q = brute_quality(r[1])
        if q[0] >= 50 and 100 * q[6] <= 50 * q[0] and q[4] <= 0.3 * q[3] and q[5] <= 0.2 * q[1] and q[7] <= 0.15 * q[1] and q[8] <= 0.1 * q[1] and q[2] <= 0.1 * q[0]:
            good.append(r)
    lines = list(brute_lines(good))
    groups = jaccard([(r[0], r[1]) for r in lines], 5, 80)
    single = [r for r in lines if groups[r[0]][1] == r[0]]
    mixed = [tuple(r) for r in mixing.mix_sources(spark.createDataFrame(single, DOCS)).collect()]
    library = Tokenizer.from_file(pt.path("word_bpe_49k.json"))
    want = sorted((r[0], struct.pack(f"<{len(i)}I", *i)) for r in mixed for i in [library.encode(r[1], add_special_tokens=False).ids])
    docs_now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for (name, stage), rows_after in zip(corpus_pipeline.STAGES[:-1], (good, lines, single, mixed), strict=True):
        docs_now = stage(spark, docs_now, str(tmp_path))
        assert docs_now.columns == corpus_pipeline.COLUMNS
        assert sorted(map(repr, map(tuple, docs_now.collect()))) == sorted(map(repr, map(tuple, rows_after))), name
    assert len(good) > len(single) and len(mixed) != len(single)
    assert sorted((r.doc_id, bytes(r.ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == want


def test_stages_take_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0
