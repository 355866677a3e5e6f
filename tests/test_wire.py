import hashlib

from pyspark.sql import functions as F

from corvane.operators import evidence
from corvane.sources import wire

MESSAGE = b"\x0a\x03abc" + b"\x12\x04idid" + b"\x18\x96\x01" + b"\xa2\x06\x01z" + b"\x25\x01\x02\x03\x04"


def test_wire_fields_and_content_ids(spark):
    df = spark.createDataFrame([(1, MESSAGE), (2, MESSAGE[:-1]), (3, None), (4, b"")], "i int, raw binary")
    got = {r.i: r for r in df.select("i", wire.content_id(F.col("raw")).alias("id"), wire.fields(F.col("raw")).alias("f")).collect()}
    rest = MESSAGE.replace(b"\x12\x04idid", b"")
    assert got[1].id == hashlib.sha256(rest).hexdigest() and [x.number for x in got[1].f] == [1, 2, 3, 100, 4]
    assert int.from_bytes(got[1].f[2].value, "big") == 150
    assert got[2].id is None and got[2].f is None and got[3].id is None and got[4].id == hashlib.sha256(b"").hexdigest()


def test_solana_history(spark):
    sig = "5" * 64
    pages = [(1, "solana", "h", f'{{"jsonrpc":"2.0","id":1,"result":[{{"signature":"{sig}","slot":7,"confirmationStatus":"confirmed"}}]}}'), (2, "solana", "h", '{"jsonrpc":"2.0","id":1,"result":[{"signature":"0","slot":7}]}'), (3, "base", "h", "{}"), (5, "solana", "h", f'{{"jsonrpc":"2.0","id":1,"error":{{}},"result":[{{"signature":"{sig}","slot":7}}]}}'), (4, "base", "h", None)]
    got = evidence.history_pages(spark.createDataFrame(pages, "page_id int, chain_scope string, handle string, body string")).orderBy("page_id").collect()
    assert [(r.valid, r.transaction_id, r.finality) for r in got] == [(True, sig, "confirmed")] + 4 * [(False, None, None)]


def test_manifests(spark, tmp_path):
    good, bad = b'{"a":1,"b":"x"}', b'{"a":1,"c":2}'
    for b in (good, bad):
        (tmp_path / f"{hashlib.sha256(b).hexdigest()}.json").write_bytes(b)
    (tmp_path / ("0" * 64)).write_bytes(good)
    got = {r.reason: r.manifest for r in evidence.manifests(spark, str(tmp_path), "struct<a:int,b:string>").collect()}
    assert set(got) == {None, "unknown_field", "digest"} and tuple(got[None]) == (1, "x")


def test_projection_violations(spark):
    rows = [("a/b", "s", "see [[a/b]] [[c]]", ["p1"], ["c", "a/b"]), ("x", "s", "see [[x]] secret", ["p9"], ["x"]), ("y", "s", 'see [[y]] say \\"hi', ["p1"], ["z"])]
    pages = spark.createDataFrame(rows, "page_path string, snapshot_id string, markdown string, citations array<string>, links array<string>")
    snapshots = spark.createDataFrame([("s", ["p1", "p2"])], "snapshot_id string, provenance_ids array<string>")
    got = {r.page_path: r.reasons for r in evidence.projection_violations(pages, snapshots, ["secret", '"hi']).collect()}
    assert got == {"x": ["citation", "private"], "y": ["links", "private"]}
