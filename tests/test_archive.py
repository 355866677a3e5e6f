import hashlib

from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, IsNotNull, StringStartsWith

from corvane.sources import archive

PUSHED = "spark.sql.python.filterPushdown.enabled"


def put(root, source, day, content, name=None):
    digest = name or hashlib.sha256(content).hexdigest()
    folder = root / "evidence" / source / day / "sha256" / digest[:2]
    folder.mkdir(parents=True, exist_ok=True)
    (folder / digest).write_bytes(content)
    return digest


def filled(root):
    seen = {}
    for source in ("a", "b"):
        for day in ("2026-01-01", "2026-01-02", "2026-01-03"):
            for k in range(5):
                content = f"{source}{day}{k}".encode()
                seen[put(root, source, day, content)] = (source, day, content)
    put(root, "a", "2026-01-01", b"x", "0" * 64)
    (root / "evidence" / "a" / "2026-01-01" / "sha256" / "zz").mkdir()
    (root / "evidence" / "a" / "not-a-day").mkdir()
    (root / "evidence" / "a" / "2026-01-02" / "sha256" / "00").mkdir(exist_ok=True)
    (root / "evidence" / "a" / "2026-01-02" / "sha256" / "00" / "README").write_bytes(b"no object")
    return seen


def test_archive_reads_chosen_folders(spark, tmp_path):
    seen = filled(tmp_path)
    spark.dataSource.register(archive.ArchiveSource)
    spark.conf.set(PUSHED, "true")
    try:
        read = lambda: spark.read.format("evidence_archive").load(str(tmp_path))
        rows = read().collect()
        assert {r.digest: (r.source_id, r.day, bytes(r.content)) for r in rows if r.intact} == seen and [r.digest for r in rows if not r.intact] == ["0" * 64]
        some = read().where("source_id = 'b' AND day >= '2026-01-02'").collect()
        assert {r.digest for r in some} == {d for d, (s, day, _) in seen.items() if s == "b" and day >= "2026-01-02"}
        one = sorted(seen)[3]
        assert [r.day for r in read().where(F.col("digest") == one).collect()] == [seen[one][1]]
        assert read().where("length < 0 OR day = '1999-01-01'").count() == 0
    finally:
        spark.conf.unset(PUSHED)


def test_filters_choose_folders_before_reading(tmp_path):
    seen = filled(tmp_path)
    reader = archive.ArchiveReader({"path": str(tmp_path)})
    one = sorted(seen)[3]
    rest = [IsNotNull(("day",)), EqualTo(("length",), 3)]
    assert list(reader.pushFilters([EqualTo(("day",), "2026-01-02"), In(("source_id",), ("a",)), *rest])) == rest
    assert {(p.source, p.day) for p in reader.partitions()} == {("a", "2026-01-02")}
    reader = archive.ArchiveReader({"path": f"file://{tmp_path}/"})
    assert list(reader.pushFilters([GreaterThanOrEqual(("day",), "2026-01-02"), StringStartsWith(("digest",), one[:7])])) == []
    assert {p.prefix for p in reader.partitions()} <= {one[:2]} and all(p.day >= "2026-01-02" for p in reader.partitions())
    assert archive.ArchiveReader({"path": str(tmp_path / "none")}).partitions() == []


def test_archive_streams_each_object_once(spark, tmp_path):
    root = tmp_path / "archive"
    first = {put(root, "a", "2026-01-01", f"{k}".encode()) for k in range(4)}
    spark.dataSource.register(archive.ArchiveSource)
    got = []

    def drain():
        stream = spark.readStream.format("evidence_archive").option("settle_seconds", 0).load(str(root))
        q = stream.writeStream.foreachBatch(lambda batch, _: got.extend(r.digest for r in batch.collect())).option("checkpointLocation", str(tmp_path / "c")).start()
        q.processAllAvailable()
        q.stop()

    drain()
    assert sorted(got) == sorted(first)
    drain()
    assert len(got) == 4
    later = put(root, "b", "2025-12-31", b"late")
    drain()
    assert sorted(got) == sorted([*first, later])
    reader = archive.ArchiveStreamReader({"path": str(root), "settle_seconds": "0"})
    end = reader.latestOffset()
    parts = reader.partitions({"upto": -1}, end)
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == 5 and reader.partitions(end, end) == []
