import random

from pyspark.sql import functions as F

from corvane.operators import verification
from corvane.operators.prefix import prefix_sums


def test_prefix_sums_equal_brute_force(spark):
    rng = random.Random(1)
    rows = [("hot", h, rng.randint(-3, 9), "x") for h in rng.sample(range(5000), 2000)] + [(f"k{rng.randint(0, 40)}", rng.randint(0, 10**6), rng.randint(0, 9), None) for _ in range(900)] + [("one", 5, 1, None)]
    rows = list({(k, h): (k, h, v, x) for k, h, v, x in rows}.values())
    want, sums, before = {}, {}, {}
    for k, h, v, _ in sorted(rows, key=lambda r: r[:2]):
        sums[k] = sums.get(k, 0) + v
        want[k, h] = (before.get(k), sums[k])
        before[k] = h
    df = spark.createDataFrame(rows, "k string, h long, v long, x string").repartition(3)
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    kept_size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
        got = prefix_sums(df, "k", "h", ["v"])
        assert got.columns == ["k", "h", "v", "x", "before", "v_sum"]
        assert {(r.k, r.h): (r.before, r.v_sum) for r in got.collect()} == want
        assert len({r.p for r in got.where("k = 'hot'").select(F.spark_partition_id().alias("p")).distinct().collect()}) > 2, "a hot key is spread"
        assert prefix_sums(df.limit(0), "k", "h", ["v"]).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept_size)


def test_runs_with_broken_heights(spark):
    heights = {"a": [3, 4, 5], "b": [3, 5, 5, 9], "c": [4, 5], "d": [3, 4], "e": []}
    rows = spark.createDataFrame([(r, h) for r, hs in heights.items() for h in hs], "run_id string, height long")
    runs = spark.createDataFrame([(r, 3, 9 if r == "b" else 5) for r in heights], "run_id string, start_height long, end_height long")
    got = sorted(tuple(r) for r in verification.broken_runs(rows, runs).collect())
    assert got == [("b", "gap", 3, 5), ("b", "gap", 5, 9), ("b", "repeated", 5, 5), ("c", "start", 3, 4), ("d", "end", 4, 5), ("e", "empty", 3, 5)]


def test_collections_end_where_the_loop_would(spark):
    """Against a loop that asks height by height."""
    rng = random.Random(3)
    attempts, plans, want = [], [], {}
    for c in range(40):
        start, budget, blocks = rng.randint(0, 3), rng.randint(0, 25), rng.randint(0, 12)
        plans.append((f"c{c}", start, budget, blocks))
        there = {h: (rng.randint(1, 4), rng.random() < 0.9) for h in range(15) if rng.random() < 0.95}
        attempts += [(f"c{c}", h, a, ok and a == n - 1) for h, (n, ok) in there.items() for a in range(n)]
        used, done, at, reason = 0, 0, start, None
        while reason is None:
            if done == blocks:
                reason = "blocks"
            elif used >= budget:
                reason = "budget"
            elif at not in there:
                reason = "end"
            else:
                n, ok = there[at]
                if used + n > budget:
                    used, reason = budget, "budget"
                else:
                    used += n
                    done, at, reason = (done + 1, at + 1, None) if ok else (done, at, "failed")
        want[f"c{c}"] = (at, done, used, reason)
    got = verification.collected(spark.createDataFrame(attempts, "chain string, height long, attempt int, ok boolean"), spark.createDataFrame(plans, "chain string, start_height long, request_budget long, max_blocks long"))
    assert {r.chain: tuple(r)[1:] for r in got.collect()} == want


def test_plans_have_no_window_over_a_run(spark):
    rows = spark.createDataFrame([("a", 1)], "run_id string, height long")
    plan = prefix_sums(rows, "run_id", "height", [])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 1 and plan.index("Window") < plan.index("Aggregate"), "only over one row of each task"
