import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import finality
from corvane.streaming.finality import finality_stream
from corvane.streaming.ingest import ContradictoryReplay, append_once, drain, hourly

SCHEMA = "canonical_event_id string, evidence_id string, asserted_at long, block_number long, block_hash string, canonical_block_hash string, latest_block long, finalized_block long, reverted boolean"


def test_append_once(spark, tmp_path):
    out, notes = str(tmp_path / "out"), str(tmp_path / "notes")
    write = append_once(out, notes, ["id"])
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "id long, v string")
    write(a, 0)
    write(a, 0)
    write(a, 1)
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == [(1, "x"), (2, "y")]
    with pytest.raises(ContradictoryReplay):
        write(spark.createDataFrame([(1, "z"), (3, "n")], "id long, v string"), 2)
    assert spark.read.parquet(out).count() == 2


def test_drain_and_hours(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [("2026-01-01 00:10:00", "x402", "base"), ("2026-01-01 00:50:00", "x402", "base"), ("2026-01-01 02:00:00", "mpp", "base")]
    df = spark.createDataFrame(rows, "settled_at string, protocol string, chain_scope string").withColumn("settled_at", F.col("settled_at").cast("timestamp"))
    df.withColumn("id", F.monotonically_increasing_id()).write.parquet(source)
    schema = spark.read.parquet(source).schema
    drain(spark.readStream.schema(schema).parquet(source), append_once(str(tmp_path / "o"), str(tmp_path / "r"), ["id"]), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "o")).count() == 3
    q = hourly(spark.readStream.schema(schema).parquet(source)).writeStream.outputMode("complete").format("memory").queryName("hours").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.settlement_count for r in spark.table("hours").collect()) == [1, 2]


def test_finality_stream_equals_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = []
    for s in range(20):
        for i in range(rng.randint(1, 6)):
            b, h = rng.choice([10, 12]), rng.choice(["0xa", "0xb"])
            rows.append((f"e{s}", f"v{i}", rng.randint(1, 4), b, h, rng.choice([h, "0xz"]), b + rng.randint(0, 9), b - rng.randint(0, 5), rng.random() < 0.1))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    source = str(tmp_path / "in")
    for part in (rows[::3], rows[1::3], rows[2::3]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    seen: dict = {}

    def keep(batch, _):
        for r in batch.collect():
            seen[r.canonical_event_id] = tuple(r)[1:]

    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    q = finality_stream(stream, 5).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert seen == {r.canonical_event_id: tuple(r)[1:] for r in finality.timelines(df, 5).collect()}


def test_state_by_inclusion_equals_batch_and_reads_its_own_block(spark, tmp_path):
    from corvane.streaming.finality import ROCKSDB, finality_by_inclusion

    rng = random.Random(6)
    rows = []
    for e in range(12):
        for i in range(rng.randint(1, 8)):
            b, h = rng.choice([10, 12]), rng.choice(["0xa", "0xb"])
            rows.append((f"e{e}", f"v{i}", rng.randint(1, 4), b, h, rng.choice([h, "0xz"]), b + rng.randint(0, 9), b - rng.randint(0, 5), rng.random() < 0.2))
    rng.shuffle(rows)
    source, seen = str(tmp_path / "in"), {}
    for part in (rows[::3], rows[1::3], rows[2::3] + rows[:5]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    before = spark.conf.get(ROCKSDB[0], None)
    spark.conf.set(*ROCKSDB)
    try:
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        keep = lambda batch, _: seen.update({r.canonical_event_id: tuple(r)[1:] for r in batch.collect()})
        finality_by_inclusion(stream, 5).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(ROCKSDB[0], before) if before else spark.conf.unset(ROCKSDB[0])
    want = {r.canonical_event_id: tuple(r)[1:] for r in finality.timelines(spark.createDataFrame(rows, SCHEMA), 5).collect()}
    assert seen == want and any(r[2] for r in want.values())


def test_commits_come_into_view_whole(spark, tmp_path):
    from corvane.streaming import commits

    root = str(tmp_path / "store")
    one = {"a": spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string"), "b": spark.createDataFrame([], "k long")}
    bad = spark.createDataFrame([(1,)], "k long")
    with pytest.raises(commits.Rejected):
        commits.commit(root, "b1", one, {"rule": bad})
    assert commits.commit(root, "b1", one, {"rule": bad.limit(0)}) and not commits.commit(root, "b1", one)
    with pytest.raises(commits.ContradictoryReplay):
        commits.commit(root, "b1", one | {"a": one["a"].limit(1)})
    one["a"].write.parquet(f"{root}/a/attempt=b2")  # an attempt that ended before its receipt
    assert sorted(tuple(r) for r in commits.committed(spark, root, "a", one["a"].schema).select("batch_id", "k").collect()) == [("b1", 1), ("b1", 2)]
    assert commits.commit(root, "b2", {"a": one["a"].limit(1)})
    assert commits.committed(spark, root, "a", one["a"].schema).count() == 3


def test_contradictions_inside_a_batch(spark, tmp_path):
    write = append_once(str(tmp_path / "t"), str(tmp_path / "r"), ["k"], prune="k")
    write(spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k long, v string"), 0)
    with pytest.raises(ContradictoryReplay):
        write(spark.createDataFrame([(3, "a"), (3, "b")], "k long, v string"), 1)
    with pytest.raises(ContradictoryReplay):
        write(spark.createDataFrame([(2, "c")], "k long, v string"), 2)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_one_of_two_writers_moves_a_cursor(spark, tmp_path, monkeypatch):
    from corvane.sources import storage
    from corvane.streaming import commits

    root = str(tmp_path / "store")
    rows = lambda k: {"a": spark.createDataFrame([(k,), (k,)], "k long")}
    assert commits.cursor(spark, root, "base") is None
    assert commits.commit(root, "b1", rows(1), move=("base", None, "10"))
    with pytest.raises(commits.Conflict):
        commits.commit(root, "b2", rows(2), move=("base", None, "20"))
    assert commits.commit(root, "b2", rows(2), move=("base", "10", "20")) and commits.cursor(spark, root, "base") == "20"
    create, rivals = storage.create_file, iter([("b3", "20"), ("x", None)])

    def slow(spark, path, text):  # another writer comes first
        monkeypatch.setattr(storage, "create_file", create)
        name, expected = next(rivals)
        assert commits.commit(root, name, rows(3), move=("base", expected, "30") if expected else None)
        return create(spark, path, text)

    monkeypatch.setattr(storage, "create_file", slow)
    with pytest.raises(commits.Conflict):
        commits.commit(root, "b4", rows(4), move=("base", "20", "40"))
    monkeypatch.setattr(storage, "create_file", slow)
    assert commits.commit(root, "b4", rows(4), move=("base", "30", "40")), "a batch that moves nothing lets it through at its second try"
    assert commits.cursor(spark, root, "base") == "40"
    got = sorted((r.batch_id, r.k) for r in commits.committed(spark, root, "a", "k long").collect())
    assert got == [(b, k) for b, k in (("b1", 1), ("b2", 2), ("b3", 3), ("b4", 4), ("x", 3)) for _ in range(2)]
    assert [r.number for r in commits.receipts(spark, root).orderBy("number").collect()] == [1, 2, 3, 4, 5]
    assert commits.broken_chain(spark, root).count() == 0
    assert len(storage.file_names(spark, f"{root}/a")) == 5, "what lost is deleted"
    assert not storage.create_file(spark, f"{root}/_receipts/000000000001.json", "x")


@pytest.mark.parametrize("seed", [1])
def test_pulse_by_deltas_equals_recomputation(spark, tmp_path, seed):
    """Batches in any order, with late, repeated and reversed finality, and events that take turns."""
    from corvane.operators import readmodels
    from corvane.streaming import pulse

    rng = random.Random(seed)
    settlements = [("ns", "x402", "base", f"e{i}", f"s{i}", rng.choice([None, "b1", "b2", "b3"]), rng.choice(["USDC", "EURC"]), str(rng.randint(0, 10**rng.randint(1, 30))), f"2026-01-01 0{rng.randint(0, 3)}:10:00", f"p{rng.randint(0, 4)}") for i in range(30)]
    updates = [("ns", "x402", "base", f"e{i}", q, rng.choice(["observed", "finalized", "finalized", "orphaned"])) for i in range(30) for q in range(rng.randint(0, 4))]
    provenance = spark.createDataFrame([("ns", f"p{i}", f"2026-01-02 00:00:0{i}") for i in range(4)], "namespace_id string, provenance_id string, observed_at string").withColumn("observed_at", F.col("observed_at").cast("timestamp_ntz"))
    frame = lambda rows: spark.createDataFrame(rows, pulse.SETTLEMENTS.replace("timestamp_ntz", "string")).withColumn("settled_at", F.col("settled_at").cast("timestamp_ntz"))
    root, done = str(tmp_path / "store"), ([], [])
    rng.shuffle(settlements), rng.shuffle(updates)
    known = [s for s in settlements if s[9] != "p4"]  # without provenance a settlement isn't shown: here each cell has some
    for k in range(3):
        mine, said = known[k::3] + known[:2], updates[k::3]
        assert pulse.apply_batch(root, f"b{k}", frame(mine), spark.createDataFrame(said, pulse.UPDATES))
        done[0].extend(mine), done[1].extend(said)
        want = readmodels.pulse(frame(sorted(set(done[0]), key=str)), spark.createDataFrame(done[1], pulse.UPDATES), provenance)
        got = pulse.pulse(spark, root, provenance)
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect())), k
    pulse.apply_batch(root, "late", frame([]), spark.createDataFrame([(*x[:4], 9, "orphaned") for x in known[:20]], pulse.UPDATES))
    done[1].extend((*x[:4], 9, "orphaned") for x in known[:20])
    want = readmodels.pulse(frame(sorted(set(done[0]), key=str)), spark.createDataFrame(done[1], pulse.UPDATES), provenance)
    assert sorted(map(str, pulse.pulse(spark, root, provenance).select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert pulse.committed(spark, root, "seen", pulse.SEEN).where("n < 0").count(), "something was taken back"
