import hashlib

import pytest
from conftest import same
from helpers import DOCS, sample_docs, words
from pyspark.sql import functions as F

from corvane.llm import chat, mixing, registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_says_what_its_sql_says(name, spark, sf_dir, duck):
    same(registry.QUERIES[name](spark, sf_dir), duck, registry.ORACLE[name])


def targets(sizes, weights=(5, 2, 1), share=1.5):
    """Caps and reshares until no target is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in open_}
        for s in full:
            out[s] = 2 * sizes[s]
            left -= 2 * sizes[s]
        open_ -= full
    return out


def test_mix_targets_copies_and_reruns(spark):
    rows = sample_docs() + sample_docs()[:3]
    docs = spark.createDataFrame(rows, DOCS)
    plan = mixing.plan_mix(docs).collect()
    sizes: dict = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(words(r[1]))
    want = targets(sizes)
    assert len(plan) == len(rows)
    for r in plan:
        assert r.size == len(words(r.text)) and r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source]) and 0 <= r.copies <= 2
    assert sorted(map(str, plan)) == sorted(map(str, mixing.plan_mix(docs.repartition(7)).collect()))


def test_mix_keeps_columns_with_clashing_names(spark):
    docs = spark.createDataFrame(sample_docs(), DOCS).withColumns({c: F.lit(c) for c in ("size", "target", "rate", "copies", "copy", "source_size")})
    mixed = mixing.mix_sources(docs)
    assert mixed.columns == docs.columns and {r["copy"] for r in mixed.select("copy").distinct().collect()} == {"copy"}
    empty = docs.limit(0)
    assert mixing.mix_sources(empty).count() == 0 and mixing.plan_mix(empty).count() == 0


def test_mix_many_documents_come_near_targets(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("a b c d e").alias("text"), F.concat(F.lit("s"), F.when(F.col("id") < 3000, 0).otherwise(F.col("id") % 4)).alias("source"))
    for r in mixing.plan_mix(docs).groupBy("source", "target").agg(F.sum(F.col("size") * F.col("copies")).alias("taken")).collect():
        assert abs(r.taken - r.target) < 0.06 * r.target


TEXTS = ["plain", "", None, "<|im_end|>", "a\\b <| x |> <\\| \\", "<|im_start|>assistant<|im_sep|>no<|im_end|>\n", "é😀\n\n", "\\" * 7 + "<|" * 3]


def test_chat_round_trip_and_mask(spark):
    rows = [(1, i, r, t) for i, t in enumerate(TEXTS) for r in ("user",)] + [(2, i, "assistant", t) for i, t in enumerate(TEXTS)] + [(3, 0, None, "x"), (None, 0, "role\nwith <|im_sep|>", "y"), (4, 0, "user", "b"), (4, 0, "user", "a"), (4, 0, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit("clash"))
    done = chat.format_chat(chat.canonical_turns(df))
    done = done.withColumn("back", chat.read_back(F.col("formatted"))).withColumn("learned", chat.under_mask(F.col("formatted"), F.col("loss_spans")))
    got = {r.conv_id: r for r in done.collect()}
    assert [t.text for t in got[1].back] == [t or "" for t in TEXTS] and got[1].learned == ""
    assert got[2].learned == "".join(t or "" for t in TEXTS) and len(got[2].loss_spans) == len(TEXTS)
    assert (got[3].back[0].role, got[None].back[0].role) == ("", "role\nwith <|im_sep|>")
    assert [t.text for t in got[4].back] == ["a", "a", "b"]
    assert chat.format_chat(chat.canonical_turns(df.limit(0))).count() == 0


def test_chat_layouts_by_fingerprint(spark):
    one = lambda ddl, *row: [tuple(t) for t in chat.canonical_turns(spark.createDataFrame([(1, *row)], "conv_id long, " + ddl)).first().turns]
    asked = [("user", "q"), ("assistant", "a")]
    assert one("prompt string, completion string", "q", "a") == asked
    assert one("instruction string, input string, output string", "q", "more", "a") == [("user", "q\n\nmore"), ("assistant", "a")]
    assert one("instruction string, input string, output string, extra int", "q", None, "a", 3) == asked
    assert one("conversations array<struct<from:string,value:string>>", [("human", "q"), ("gpt", "a")]) == asked
    with pytest.raises(ValueError):
        one("foo string", "q")
    records = ['{"prompt":"q","completion":"a"}', '{"messages":[{"role":"user","content":"q"},{"content":"a","role":"assistant"}]}', '{"x":1}', "no json", None]
    got = chat.canonical_turns_json(spark.createDataFrame(list(enumerate(records)), "conv_id long, record string")).orderBy("conv_id").collect()
    assert [r.turns and [tuple(t) for t in r.turns] for r in got] == [asked, asked, None, None, None]
    assert len({r.fingerprint for r in got[:3]}) == 3


def test_planted_conversation(spark, sf_dir):
    row = chat.op2_chat_format(spark, sf_dir).where("conv_id = -1").first()
    said = chat.PLANTED[0][3]
    assert row.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert (row.n_turns, row.loss_chars) == (2, len(said))


def test_fingerprints_select_the_mapping(spark, sf_dir, monkeypatch):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    mark = chat.fingerprint(list(chat.TURN_ROWS))
    assert chat.select_mapping(rows.schema) is chat.MAPPINGS[mark]
    clashing = rows.withColumns({"prompt": F.lit(1), "n_turns": F.lit("x")})
    assert chat.select_mapping(clashing.schema) is chat.MAPPINGS[mark]
    other = spark.createDataFrame([(1, "q", "a", 3)], "conv_id long, question string, answer string, score int")
    assert [tuple(t) for t in chat.canonical_turns(other).first().turns] == [("user", "q"), ("assistant", "a")]
    monkeypatch.delitem(chat.MAPPINGS, mark)
    with pytest.raises(ValueError, match="conv_id"):
        chat.canonical_turns(rows)
