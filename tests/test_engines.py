import hashlib
import random

import pytest
from pyspark.sql import functions as F

from corvane.functions import amounts, codec
from corvane.operators import adapters, attribution, catalog, classification, evidence, finality, fragments, latest, reducer
from corvane.plans import queries
from corvane.streaming.finality import fold


def test_codec_matches_hashlib(spark):
    raw = b"".join(len(t.encode()).to_bytes(8, "big") + t.encode() for t in ("é", "", "abc"))
    row = spark.range(1).select(codec.sha256(codec.fields(F.lit("é"), F.lit(""), F.lit("abc"))).alias("h")).first()
    assert row.h == hashlib.sha256(raw).hexdigest()


def test_exact_sum_of_78_digits(spark):
    values = ["9" * 76, amounts.U128_MAX, "0", "1"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert df.agg(amounts.exact_sum(F.col("v")).alias("s")).first().s == str(sum(map(int, values)))
    assert spark.createDataFrame([("0",)], "v string").agg(amounts.exact_sum(F.col("v")).alias("s")).first().s == "0"


def test_canonical_amounts(spark):
    rows = [("0", True), ("10", True), ("01", False), ("", False), ("-1", False), (None, False), ("1.0", False), (amounts.U128_MAX, True), ("3" + amounts.U128_MAX[1:-1] + "6", False)]
    df = spark.createDataFrame(rows, "v string, e boolean")
    assert df.where(~(amounts.fits_u128(F.col("v")) == F.col("e"))).count() == 0


SETTLEMENT = [("settlement:base:0xabc", "x402", "base", "USDC", "1000", "0xmerchant", None, "evidence:settlement")]
S_SCHEMA = "settlement_id string, protocol string, network string, asset string, amount_atomic string, pay_to string, requirement_id string, evidence_id string"
REQUIREMENT = ("requirement:weather", "option:requirement:weather", "endpoint:forecast", "service:weather", "x402", "base", "USDC", "1000", "0xmerchant", "evidence:requirement:weather")
R_SCHEMA = "requirement_id string, payment_option_id string, endpoint_id string, service_id string, protocol string, network string, asset string, amount_atomic string, pay_to string, evidence_id string"


def test_attribution_golden_hashes(spark):
    s, r = spark.createDataFrame(SETTLEMENT, S_SCHEMA), spark.createDataFrame([REQUIREMENT], R_SCHEMA)
    found = attribution.candidates(s, r).first()
    assert found.level == "strong" and found.confidence_bps == 8500
    assert found.candidate_id == "attribution:sha256:fd944928106a9ff25d29d135f1467c4c6d04aab4d5f6d133e6a8bc174ab5543c"
    requirement = F.array(F.struct(*[F.lit(v).alias(n.split()[0]) for v, n in zip(REQUIREMENT, R_SCHEMA.split(", "), strict=True)], F.array(F.lit(REQUIREMENT[-1])).alias("evidence_ids")))
    one = s.withColumnRenamed("requirement_id", "explicit_id").withColumn("evidence_ids", F.array("evidence_id")).withColumn("requirements", requirement)
    one = one.withColumn("input_hash", attribution.input_hash())
    assert one.first().input_hash == "3528c70ac97a99b18cb00274f4caaee398eb4c13d40b71879d9bbe3a960c0b65"
    candidate = F.struct(
        F.lit(found.candidate_id).alias("candidate_id"), *[F.lit(v).alias(n) for v, n in zip(REQUIREMENT[:4], attribution.TARGET, strict=True)], F.lit(8500).alias("confidence_bps"),
        F.array(F.lit("evidence:requirement:weather"), F.lit("evidence:settlement")).alias("evidence_ids"),
    )
    done = one.withColumn("level", F.lit("strong")).withColumn("method", F.lit("unique_exact")).withColumn("candidates", F.array(candidate))
    assert done.select(attribution.state_hash("attribution@1").alias("h")).first().h == "09f33b946816d5d17f7fc2d49ab90c567a5505d5d9a3f4eaeba1de96a1bc591b"


def test_attribution_levels(spark):
    other = ("requirement:b", *REQUIREMENT[1:])
    wrong = ("requirement:c", *REQUIREMENT[1:7], "7", *REQUIREMENT[8:])
    explicit = [(*SETTLEMENT[0][:6], "requirement:b", "e")]
    missing = [(*SETTLEMENT[0][:6], "requirement:c", "e")]
    level = lambda s, r: attribution.levels(spark.createDataFrame(s, S_SCHEMA), spark.createDataFrame(r, R_SCHEMA)).first().level
    assert level(SETTLEMENT, [REQUIREMENT, other]) == "weak"
    assert level(SETTLEMENT, [wrong]) == "unknown"
    assert level(explicit, [REQUIREMENT, other]) == "verified"
    assert level(missing, [REQUIREMENT, wrong]) == "unknown"


ACTIVITIES = [("b", "200", 120, "mpp", "maps", "verified_agent"), ("b", "100", 60, "x402", "weather", "unknown"), ("b", "300", 240, "x402", "weather", "verified_agent")]
A_SCHEMA = "subject_id string, amount_atomic string, occurred_at long, protocol string, counterparty string, autonomy string"


def test_features(spark):
    row = classification.features(spark.createDataFrame(ACTIVITIES, A_SCHEMA)).first()
    assert [str(row[m]) for m in classification.METRICS] == ["600", "3", "90", "2", "1", "2", "2", "2"]
    alone = classification.features(spark.createDataFrame(ACTIVITIES[:1], A_SCHEMA)).first()
    assert alone.median_cadence_seconds is None
    wide = [("b", "1", -(2**63), "x402", "c", "unknown"), ("b", "1", 2**63 - 1, "x402", "c", "unknown")]
    assert int(classification.features(spark.createDataFrame(wide, A_SCHEMA)).first().median_cadence_seconds) == 2**64 - 1
    assert classification.feature_violations(classification.features(spark.createDataFrame(ACTIVITIES, A_SCHEMA))).count() == 0
    assert classification.outside_window(spark.createDataFrame(ACTIVITIES, A_SCHEMA), 60, 240).count() == 1


def test_labels_and_drift(spark):
    labels = spark.createDataFrame([("core:high-frequency", 1, "core", "payment_count", "3", 1), ("local:high-spend", 7, "local", "total_spend_atomic", "500", 1)], "label_id string, label_version int, label_kind string, metric string, threshold string, confidence_bps int")
    run = lambda a: classification.claims(classification.features(spark.createDataFrame(a, A_SCHEMA)), labels)
    baseline = run(ACTIVITIES)
    assert {r.label_id for r in baseline.collect()} == {"core:high-frequency", "local:high-spend"}
    replay = run([(*ACTIVITIES[0][:1], "100", *ACTIVITIES[0][2:]), ACTIVITIES[1], (*ACTIVITIES[2][:1], "200", *ACTIVITIES[2][2:])])
    row = classification.drift(baseline, replay).first()
    assert (row.added, row.removed, row.churn) == ("", "local:high-spend@7", 1)


def test_reducer_majority_and_ties(spark):
    rows = [("n", "e", "o1", "a"), ("n", "e", "o2", "a"), ("n", "e", "o3", "b"), ("n", "f", "o4", "a"), ("n", "f", "o5", "b")]
    df = spark.createDataFrame(rows, "namespace_id string, canonical_event_id string, observation_id string, payload string")
    for frame in (df, df.orderBy(F.desc("observation_id")).repartition(3)):
        got = {r.observation_id: r.support_role for r in reducer.links(frame).collect()}
        assert (got["o1"], got["o2"], got["o3"]) == ("supporting", "supporting", "conflicting")
        prints = {p: hashlib.sha256(b"\0\0\0\0\0\0\0\1" + p.encode()).hexdigest() for p in "ab"}
        assert got["o4" if prints["a"] < prints["b"] else "o5"] == "supporting"


def test_delayed_orphan_stays_behind(spark):
    rows = [("e", "x", 100, 10, "0xaaa", "0xaaa", 10, 0, False), ("e", "y", 200, 12, "0xccc", "0xccc", 17, 0, False), ("e", "z", 300, 10, "0xaaa", "0xbbb", 18, 0, False)]
    schema = "canonical_event_id string, evidence_id string, asserted_at long, block_number long, block_hash string, canonical_block_hash string, latest_block long, finalized_block long, reverted boolean"
    for order in (rows, rows[::-1]):
        row = finality.timelines(spark.createDataFrame(order, schema), 5).first()
        assert (row.current_status, row.n_updates, row.n_conflicts) == ("confirmed", 3, 0)
    with pytest.raises(ValueError):
        finality.evm_status(0)


def test_finality_fold_equals_python(spark):
    rng = random.Random(2)
    schema = "canonical_event_id string, evidence_id string, asserted_at long, block_number long, block_hash string, canonical_block_hash string, latest_block long, finalized_block long, reverted boolean"
    rows = []
    for s in range(150):
        for i in range(rng.randint(1, 7)):
            b, h = rng.choice([10, 12, 300]), rng.choice(["0xa", "0xbb"])
            rows.append((f"e{s}", f"v{i}", rng.randint(1, 4), b, h, rng.choice([h, h, "0xz"]), b + rng.randint(0, 9), b - rng.randint(-1, 5), rng.random() < 0.1))
    got = {r[0]: tuple(r)[1:] for r in finality.timelines(spark.createDataFrame(rows, schema), 5).collect()}
    want: dict = {}
    for r in rows:
        status = "orphaned" if r[4] != r[5] else "reverted" if r[8] else "finalized" if r[7] >= r[3] else "confirmed" if r[6] >= r[3] + 5 else "observed"
        want.setdefault(r[0], []).append([r[2], finality.STATUSES.index(status), r[3], r[4], r[5], r[6], r[7], int(r[8]), r[1], status])
    assert got == {k: fold(v) for k, v in want.items()}


def test_candidate_health_over_time(spark):
    c = spark.createDataFrame([("c",), ("u",)], "candidate_id string")
    checks = spark.createDataFrame([("c", f"k{i}", f"2026-01-01 00:0{i}:00", "dead") for i in (1, 2, 3)], "candidate_id string, check_id string, checked_at string, outcome string").withColumn("checked_at", F.col("checked_at").cast("timestamp_ntz"))
    at = lambda t: {r[0]: r[1] for r in catalog.candidate_health(c, checks, t).collect()}
    assert at("2026-01-01 00:02:30") == {"c": "stale", "u": "unseen"}
    assert at("2026-01-01 00:03:30")["c"] == "dead"


def test_readiness_after_14_days(spark):
    from corvane.operators.readmodels import readiness

    rows = [(f"2026-09-{i:02d}", 2501, 100_000_001 if i == 14 else 5, 10, True) for i in range(1, 15)]
    df = spark.createDataFrame(rows, "d string, p95_query_latency_ms long, canonical_event_count long, analytics_cpu_percent int, materialized_views_tuned boolean")
    df = df.select(F.lit("n").alias("namespace_id"), F.to_date("d").alias("measured_on"), "*").drop("d")
    last = readiness(df).orderBy(F.desc("measured_on")).first()
    assert (last.latency_days, last.scale_days, last.ready) == (14, 1, True)
    assert readiness(df.where("measured_on <> DATE'2026-09-03'")).where("ready").count() == 0


OFFER = '{"scheme":"exact","network":"eip155:8453","amount":"1000","asset":"0xA","payTo":"0xM"}'


def test_adapters(spark):
    docs = lambda *texts: spark.createDataFrame([(f"e{i}", "https://a/", t) for i, t in enumerate(texts)], "evidence_id string, endpoint string, content string")
    said = lambda rows: [(r.evidence_id, r.reason) for r in rows.orderBy("evidence_id").collect()]
    import base64

    body2 = f'{{"x402Version":2,"accepts":[{OFFER}]}}'
    header = lambda body: "HTTP/1.1 402 Payment Required\r\nPAYMENT-REQUIRED: " + base64.b64encode(body.encode()).decode() + "\r\n\r\n{}"
    v2 = header(body2)
    body1 = '{"x402Version":1,"accepts":[' + OFFER.replace('"amount":"1000"', '"maxAmountRequired":"0900"') + "]}"
    v1 = f"HTTP/1.1 402 Payment Required\r\n\r\n{body1}"
    got = adapters.runtime(docs(v2, v1, "HTTP/1.1 402 X\r\n\r\n{}", v2.replace(" 402 ", " 200 "))).orderBy("evidence_id").collect()
    assert [(r.protocol_version, r.amount_atomic, r.reason) for r in got] == [(2, "1000", None), (1, "0900", None), (None, None, "malformed"), (None, None, "invalid_runtime_response")]
    gap = body1.replace(",", ",\r\n\r\n", 1)  # a blank line inside the body
    odd = [
        f"HTTP/1.1 402 X\r\n\r\n{gap}", v1.replace("\r\n", "\n"), v2.replace("HTTP/1.1", "HTTP/2"), v2.replace(" Payment Required", ""), v2.replace("PAYMENT", "X: y\r\npayment-required: e30=\r\nPAYMENT", 1),
        v1.replace("\r\n\r\n", "\r\nPayment-Required: \r\n\r\n"), f"HTTP/1.1 402 X\r\n\r\n{body2}", header(body1), "no blank line", None,
    ]
    wrong = ["invalid_runtime_response", "invalid_runtime_response", "missing_payment_required", None, "missing_payment_required", "unsupported_version", "invalid_runtime_response", "invalid_runtime_response"]
    assert said(adapters.runtime(docs(*odd))) == [(f"e{i}", r) for i, r in enumerate([None, None, *wrong])]
    api = lambda more, version='"openapi":"3.0.1",': f'{{{version}"paths":{{"/premium":{{"get":{{"x-x402":{body2}}},"GET":{{"x-x402":{{}}}},"foo":{{"x-x402":{{}}}}{more}}}}}}}'
    own = body2.replace('"payTo"', '"resource":"https://own","payTo"')
    texts = [api(""), api(f',"put":{{"x-x402":{own}}}'), api(',"put":{"x-x402":{}}'), api("", ""), api("", '"openapi":"3.0.evil",'), api("", '"openapi":"3.2.0",'), api("", '"openapi":3.0,'), '{"openapi":"3.1.0","paths":{}}', '{"openapi":"3.1.0","paths":{"/a":1}}']
    one = adapters.openapi(docs(*texts)).orderBy("evidence_id", "resource").collect()
    assert [(r.evidence_id, r.resource) for r in one[:3]] == [("e0", "https://a/premium"), ("e1", "https://a/premium"), ("e1", "https://own")]
    assert [r.reason for r in one[3:]] == ["malformed", "malformed", "malformed", "malformed", "malformed", "missing_accepts", "malformed"]
    usdc = OFFER.replace("0xA", adapters.NAMED_ASSET)
    fine = [OFFER, OFFER.replace("1000", "1.5"), OFFER.replace("exact", "siwx"), usdc, usdc[:-1] + ',"extra":{"name":"USD Coin"}}', OFFER[:-1] + ',"maxAmountRequired":"1000"}']
    snapshot = lambda *offers: f'{{"items":[{{"resource":"r","x402Version":2,"accepts":[{",".join(offers)}]}}]}}'
    seen = adapters.catalog(docs(snapshot(*fine)))
    assert sorted(str(r.reason) for r in seen.collect()) == ["None", "None", "None", "invalid_amount", "invalid_token_metadata"]
    assert adapters.accepted(seen).count() == 3 and adapters.quarantined(seen).count() == 2
    bad = [OFFER[:-1] + ',"maxAmountRequired":"9"}', OFFER[:-1] + ',"maxAmountRequired":null}', OFFER.replace('"1000"', "1000"), OFFER[:-1] + ',"extra":[]}', OFFER.replace('"asset":"0xA",', "")]
    assert said(adapters.catalog(docs(*[snapshot(OFFER, b) for b in bad], snapshot(OFFER).replace('"r"', '" "'), '{"items":[]}'))) == [(f"e{i}", "malformed") for i in range(6)]
    texts = ['{"x402Version":2,"x402Version":2,"accepts":[]}', body2.replace("exact", "upto"), body2.replace("2,", "7,"), '{"x402Version":1,"accepts":[]}', body2.replace(OFFER, f"{OFFER},{usdc}"), own, body2.replace(OFFER, f'{OFFER},{OFFER.replace("exact", "upto")}')]
    assert said(adapters.well_known(docs(*texts))) == [("e0", "malformed"), ("e1", "unsupported_scheme"), ("e2", "unsupported_version"), ("e3", "missing_accepts"), ("e4", "invalid_token_metadata"), ("e5", None), ("e6", None)]
    assert adapters.well_known(docs(own, body2)).orderBy("evidence_id").first().resource == "https://own"


def test_mpp_adapter_rejects_whole_documents(spark):
    offer = '{"intent":"charge","method":"m","amount":"5","currency":"usd"}'
    doc = lambda o: f'{{"openapi":"3.1.0","info":{{"title":"t","version":"1"}},"paths":{{"/p":{{"post":{{"x-payment-info":{{"offers":[{offer},{o}]}},"responses":{{"402":{{}}}}}}}}}}}}'
    df = spark.createDataFrame([("a", doc(offer)), ("b", doc(offer.replace("charge", "gift"))), ("c", doc(offer.replace('"amount"', '"price"')))], "evidence_id string, content string")
    got = adapters.mpp_offers(df).collect()
    assert [(r.evidence_id, r.amount) for r in got] == [("a", "5"), ("a", "5")]


def test_evidence_helpers(spark, tmp_path):
    digest = hashlib.sha256(b"x").hexdigest()
    p = tmp_path / f"evidence/src/2026-01-01/sha256/{digest[:2]}"
    p.mkdir(parents=True)
    (p / digest).write_bytes(b"x")
    (p / ("0" * 64)).write_bytes(b"y")
    got = evidence.read_evidence(spark, str(tmp_path)).collect()
    assert sorted(r.intact for r in got) == [False, True]
    raw = evidence.RPC_MAGIC + b"\2" + (77).to_bytes(8, "big") + (200).to_bytes(2, "big") + (3).to_bytes(4, "big") + b"\1" + (9).to_bytes(8, "big") + (2).to_bytes(4, "big") + b"ok"
    wrong = [raw + b"!", b"XXXX" + raw[4:], raw[:8] + b"\xff" + raw[9:], raw[:23] + b"\2" + raw[24:], raw[:35], None]
    row = [r.e for r in spark.createDataFrame([(raw,), *[(w,) for w in wrong]], "r binary").select(evidence.rpc_envelope(F.col("r")).alias("e")).collect()]
    assert (row[0].chain, int(row[0].height), row[0].status, row[0].attempt, int(row[0].retry_after_ms), bytes(row[0].body)) == ("base", 77, 200, 3, 9, b"ok")
    assert row[1:] == [None] * len(wrong)
    evm = lambda n, more="": f'{{"jsonrpc":"2.0","id":1,"result":{{"number":"{n}"}}{more}}}'
    block = '{"jsonrpc":"2.0","id":1,"result":{"blockHeight":5,"blockhash":"b","previousBlockhash":"a","transactions":[%s],"parentSlot":%s}}'
    said = [
        (evm("0x1f"), "base", (31, None)), (evm("0x01"), "base", (None, "number")), (evm("0x123456789abcdef01"), "base", (None, "number")), (evm("0xffffffffffffffff"), "base", (2**64 - 1, None)),
        (evm("0x1f", ',"id":1'), "base", (None, "json")), (evm("0x1f", ',"error":null'), "base", (None, "result and error")), (evm("0x1f").replace("2.0", "1.0"), "base", (None, "json-rpc version")),
        ('{"jsonrpc":"2.0","id":1}', "base", (None, "result")), ('{"jsonrpc":"2.0","id":1,"result":null}', "base", (None, None)), ("x", "base", (None, "json")), (None, "base", (None, "json")),
        (block % ("", 76), "solana", (77, None)), (block % ('"t"', 77), "solana", (None, "solana block")), (block % ("", '"76"'), "solana", (None, "solana block")),
        ('{"jsonrpc":"2.0","id":1,"error":{"code":-32009}}', "solana", (None, None)), ('{"jsonrpc":"2.0","id":1,"error":{"code":-32009}}', "base", (None, "provider error")),
    ]
    got = spark.createDataFrame([(i, b, c) for i, (b, c, _) in enumerate(said)], "i int, b string, c string").select("i", evidence.decode_height(F.col("b"), F.col("c"), F.lit(77)).alias("h")).orderBy("i").collect()
    assert [(r.h.height and int(r.h.height), r.h.problem) for r in got] == [w for _, _, w in said]
    wiki = spark.createDataFrame([("a [[x]] [[y]]",), ("[[x",), ("none",)], "m string").select(evidence.wiki_links(F.col("m")).alias("l")).collect()
    assert [r.l for r in wiki] == [["x", "y"], None, []]


@pytest.mark.parametrize("limit", [1 << 20, 40, 5])
def test_fragments_equal_brute_force(spark, limit):
    import json

    texts = [(1, "a secret word here"), (2, "nothing"), (3, None), (4, "the secret worded"), (5, 'say \\"hi\\" to\\nall of them'), (6, 'say "hi" to\nall of them'), (None, "a secret word"), (1, "a secret word here"), (7, "é 😀\\u0001x")]
    items = [(1, "secret"), (2, "cret wor"), (3, None), (4, "a secret word"), (5, "zz"), (7, '"hi"'), (8, "to\nall of"), (9, "secret"), (10, "é 😀\x01x"), (11, 'say "hi" to\nall of them'), (12, '"')]
    for more in ([], [(6, "")]):
        t, f = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items + more, "fragment_id long, fragment string").withColumn("pattern", F.lit("clash"))
        got = {tuple(r) for r in fragments.fragments_in(t, f, limit).collect()}
        want = {(d, i) for d, x in texts for i, p in items + more if p is not None and (p in (x or "") or json.dumps(p, ensure_ascii=False).strip('"') in (x or ""))}
        assert got == want
    assert fragments.fragments_in(t, f.limit(0)).count() == 0 and fragments.fragments_in(t.limit(0), f).count() == 0


def test_fragments_meet_no_text_by_nested_loops(spark, sf_dir):
    found = queries.private_fragment_scan(spark, sf_dir)
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    texts = spark.createDataFrame([(1, "a secret word here")], "doc_id long, text string")
    many = spark.createDataFrame([(7, "secret w"), (8, "zzz"), (9, "a secret word")], "fragment_id long, fragment string")
    plan = fragments.fragments_in(texts, many, 4)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_pages_and_versions(spark):
    df = spark.createDataFrame([(f"a{i:02d}",) for i in range(40)], "id string")
    first = [r.id for r in latest.page(df, ["id"]).collect()]
    assert len(first) == 26 and [r.id for r in latest.page(df, ["id"], [first[24]]).collect()] == [f"a{i}" for i in range(25, 40)]
    with pytest.raises(ValueError):
        latest.page_limit(101)
    with pytest.raises(ValueError):
        latest.search(df, "")
    v = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("c", 1), ("c", 3)], "k string, v int")
    assert {r.k for r in latest.non_contiguous(v, ["k"], "v").collect()} == {"b", "c"}


def test_cursors_and_tags(spark):
    assert latest.decode_cursor(latest.encode_cursor(["é", "2"]), 2) == ["é", "2"]
    row = spark.createDataFrame([("é", 2)], "a string, b int").select(latest.cursor_of(F.col("a"), F.col("b")).alias("c")).first()
    assert row.c == latest.encode_cursor(["é", "2"])
    for bad in ("zz", "5b", latest.encode_cursor(["a"]), "7b7d"):
        with pytest.raises(ValueError):
            latest.decode_cursor(bad, 2)


def test_classification_hashes(spark):
    def enc(*fs):
        return b"".join(len(str(f).encode()).to_bytes(8, "big") + str(f).encode() for f in fs)

    rows = spark.createDataFrame([(*a, f"ev{i}") for i, a in enumerate(ACTIVITIES)], A_SCHEMA + ", evidence_id string")
    labels = spark.createDataFrame([("l:b", 2, "local", "payment_count", "3", 1), ("l:a", 1, "core", "payment_count", "9", 1)], "label_id string, label_version int, label_kind string, metric string, threshold string, confidence_bps int")
    done = classification.classify(rows, labels, 0, 300).first()
    count = lambda n: n.to_bytes(8, "big")
    items = [("100", 60, "x402", "weather", "unknown", "ev1"), ("200", 120, "mpp", "maps", "verified_agent", "ev0"), ("300", 240, "x402", "weather", "verified_agent", "ev2")]
    given = hashlib.sha256(enc("aem-behavior-input-v1", "b", 0, 300, "features@1") + count(3) + b"".join(enc(*i) for i in items)).hexdigest()
    rules = hashlib.sha256(enc("aem-label-set-v1") + count(2) + enc("l:a", 1, "core", "payment_count", "9") + enc("l:b", 2, "local", "payment_count", "3")).hexdigest()
    state = hashlib.sha256(enc("aem-classification-result-v1", "classifier@1", "b", "features@1", given, rules, 0, 300) + count(1) + enc("l:b", 2, "local", "inferred")).hexdigest()
    assert (done.input_hash, done.label_set_hash, done.state_hash, done.evidence_ids) == (given, rules, state, ["ev0", "ev1", "ev2"])
    assert classification.duplicate_labels(labels.unionByName(labels)).count() == 2 and classification.duplicate_labels(labels).count() == 0


def test_event_keys_as_protocol_buffers(spark):
    from corvane.sources import wire

    long = "s" * 300
    row = spark.range(1).select(
        wire.x402_event_id(F.lit("pay_123456789012"), F.lit("sha256:" + "a" * 64), F.lit(long), F.lit("")).alias("x"),
        wire.x402_event_id(F.lit("short"), F.lit("sha256:" + "a" * 64), F.lit("m"), F.lit("")).alias("none"),
        wire.mpp_event_id(F.lit("realm"), F.lit("tempo"), F.lit("c1")).alias("m"),
        wire.mpp_discovery_event_id(F.lit("svc"), F.lit("get"), F.lit("/p"), F.lit(200)).alias("d"),
    ).first()

    def var(n):
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + var(n >> 7)

    field = lambda k, b: bytes([k << 3 | 2]) + var(len(b)) + b
    of = lambda p, k, body: f"event:{p}:sha256:" + hashlib.sha256(field(k, body)).hexdigest()
    assert row.x == of("x402", 1, field(1, b"pay_123456789012") + field(2, b"sha256:" + b"a" * 64) + field(3, long.encode())) and row.none is None
    assert row.m == of("mpp", 2, field(1, b"realm") + field(2, b"tempo") + field(3, b"c1"))
    assert row.d == of("mpp", 3, field(1, b"svc") + field(2, b"get") + field(3, b"/p") + bytes([32]) + var(200))


def test_recovery_replay(spark):
    import base64
    import json

    from corvane.operators import recovery

    entry = lambda i, pair, **more: (f"o{i}", 1, "b", pair.split(":")[0], f"obs{i}", base64.b64encode(json.dumps({"buyer_handle_id": "b", "settlement_id": f"s{i}", "protocol": pair.split(":")[1], "amount_atomic": "9" * 30} | more).encode()).decode())
    schema = "object_name string, generation long, buyer_handle_id string, chain string, observation_id string, payload_base64 string"
    whole = [entry(i, p) for i, p in enumerate(recovery.REQUIRED)]
    one = lambda rows: recovery.replay(spark.createDataFrame(rows, schema)).first()
    a, b = one(whole), one(whole[::-1])
    assert a == b and a.reason is None and (a.n_payments, a.total_atomic) == (8, str(8 * int("9" * 30)))
    assert one(whole[1:]).reason == "coverage" and one([*whole, entry(0, "base:mpp")]).reason == "duplicate"
    assert one([*whole[1:], entry(0, recovery.REQUIRED[0], buyer_handle_id="c")]).reason == "payload"


def test_private_page_parts_merge(spark):
    b, e = evidence.BEGIN, evidence.END
    pages = ["", "a", "a\n", "a\n\n", f"x{b}old{e}y", f"{b}{b}{e}", f"{e}{b}"]
    got = [r.p for r in spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, t string").orderBy("i").select(evidence.merge_generated(F.col("t"), F.lit("new\n ")).alias("p")).collect()]
    part = f"{b}\nnew\n{e}"
    assert got == [f"{part}\n", f"a\n\n{part}\n", f"a\n\n{part}\n", f"a\n\n{part}\n", f"x{part}y", None, None]


def test_timeline_hashes_commit_to_evidence_in_any_order(spark):
    rng = random.Random(7)
    columns = "canonical_event_id string, chain_scope string, transaction_id string, source_id string, provenance_id string, evidence_id string, asserted_at long, block_number long, block_hash string, canonical_block_hash string, latest_block long, finalized_block long, reverted boolean"
    rows = [(f"e{i % 5}", "base", f"t{i % 5}", "s", "p", f"v{i}", rng.randint(1, 4), rng.choice([10, 12]), "0xa", rng.choice(["0xa", "0xa", "0xzz"]), 10 + rng.randint(2, 30), rng.randint(1, 14), rng.random() < 0.2) for i in range(60)]
    hashes = lambda r, n=5: {x.canonical_event_id: tuple(x)[1:] for x in finality.state_hashes(spark.createDataFrame(r, columns), n).collect()}
    want = hashes(rows)
    turned = rows[::-1] + rows[:7]
    rng.shuffle(turned)
    assert hashes(turned) == want and any(w[2] for w in want.values())
    assert {e: w[:3] for e, w in want.items()} == {r.canonical_event_id: tuple(r)[1:] for r in finality.timelines(spark.createDataFrame(rows, columns), 5).collect()}
    assert hashes(rows, 6)["e0"][3] != want["e0"][3], "the policy counts"
    other = hashes([(*rows[0][:5], "other", *rows[0][6:]), *rows[1:]])
    assert other["e0"][3] != want["e0"][3] and {e: w for e, w in other.items() if e != "e0"} == {e: w for e, w in want.items() if e != "e0"}
    one = rows[0]
    text = lambda t: len(t.encode()).to_bytes(8, "big") + t.encode()
    number = lambda n: n.to_bytes(8, "big")
    basis = b"\0" + number(one[7]) + text(one[8]) + text(one[9]) + number(one[10]) + number(one[11]) + bytes([one[12]])
    status = spark.createDataFrame([one], columns).select(finality.evm_status(5).alias("s")).first().s
    said = b"".join(text(c) for c in one[:6]) + number(one[6]) + bytes([finality.STATUSES.index(status)]) + number(len(basis)) + basis
    raw = text(finality.TIMELINE_TAG) + b"\0" + number(5) + b"\1" + said + b"\1" + number(0)
    assert hashes([one]) == {"e0": (status, 1, 0, hashlib.sha256(raw).hexdigest())}
    assert hashes([]) == {}
