"""The hourly pulse as a table that is kept up to date by deltas, with retractions.

A batch brings settlements and finality updates in any order. What the events of a batch added to the pulse before it is taken back and
what they add after it is put in, so a reversed finality is a row with negative numbers. All that is kept merges by adding: counts,
exact amounts in limbs, and how often each buyer and each provenance was seen in a cell; a cell's distinct buyers are those with a
positive number. Each batch looks at its own events only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.amounts import LIMB, LIMBS
from corvane.operators.latest import EVENT_KEYS, joined_set
from corvane.sources.storage import stored
from corvane.streaming.commits import commit, committed

CELL = ["namespace_id", "hour", "protocol", "chain_scope", "asset"]
_CELL = "namespace_id string, hour timestamp_ntz, protocol string, chain_scope string, asset string"
SETTLEMENTS = "namespace_id string, protocol string, chain_scope string, canonical_event_id string, settlement_id string, buyer_handle_id string, asset string, amount_atomic string, settled_at timestamp_ntz, provenance_id string"
UPDATES = "namespace_id string, protocol string, chain_scope string, canonical_event_id string, finality_sequence long, finality_status string"
LIMB_NAMES = [f"limb_{i}" for i in range(LIMBS)]
#: What a cell changes by, and by how often a buyer or provenance (kind, id) is seen in it.
DELTAS = f"{_CELL}, settlement_count long, {', '.join(f'{c} decimal(38,0)' for c in LIMB_NAMES)}"
SEEN = f"{_CELL}, kind string, id string, n long"


def _final(settlements: DataFrame, updates: DataFrame) -> DataFrame:
    now = updates.groupBy(*EVENT_KEYS).agg(F.max_by(F.col("finality_status") == "finalized", "finality_sequence").alias("final"))  # of fixed width: by hash
    return settlements.join(now.where("final").select(*EVENT_KEYS), EVENT_KEYS, "left_semi")


def _contributions(rows: DataFrame, sign: int) -> DataFrame:
    """What finalized settlements are to their cells: limbs of the amount, buyer and provenance, and the sign."""
    padded = F.lpad("amount_atomic", LIMB * LIMBS, "0")
    limbs = [(F.substring(padded, LIMB * i + 1, LIMB).cast("decimal(20,0)") * sign).cast("decimal(38,0)").alias(c) for i, c in enumerate(LIMB_NAMES)]
    return rows.select("namespace_id", F.date_trunc("hour", "settled_at").cast("timestamp_ntz").alias("hour"), "protocol", "chain_scope", "asset", "buyer_handle_id", "provenance_id", F.lit(sign).cast("long").alias("n"), *limbs)


def deltas(before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """DELTAS and SEEN of what finalized settlements were and are; cells and ids that come out even aren't listed."""
    both = stored(_contributions(before, -1).unionByName(_contributions(after, 1)))  # cells and ids both come from it
    cells = both.groupBy(*CELL).agg(F.sum("n").alias("settlement_count"), *[F.sum(c).cast("decimal(38,0)").alias(c) for c in LIMB_NAMES])
    ids = both.select(*CELL, "n", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("id")) for k, c in (("buyer", "buyer_handle_id"), ("provenance", "provenance_id"))])).alias("x"))
    seen = ids.where("x.id IS NOT NULL").groupBy(*CELL, "x.kind", "x.id").agg(F.sum("n").alias("n")).where("n <> 0")
    changed = F.col("settlement_count") != 0
    for c in LIMB_NAMES:
        changed |= F.col(c) != 0
    return cells.where(changed), seen


def apply_batch(root: str, batch_id: str, settlements: DataFrame, updates: DataFrame) -> bool:
    """Commits a batch and what it changes in the pulse; False if it was committed before.

    Settlements are keyed by namespace, chain and id: those that are stored already are let be. The pulse moves by one cursor, so of two
    writers whose deltas start from the same state one gets commits.Conflict and has to apply its batch anew.
    """
    from corvane.streaming import commits

    spark = settlements.sparkSession
    at = commits.cursor(spark, root, "pulse")
    names = lambda schema: [f.split()[0] for f in schema.split(", ")]
    key = ["namespace_id", "chain_scope", "settlement_id"]
    kept, known = committed(spark, root, "settlements", SETTLEMENTS).drop("batch_id"), committed(spark, root, "updates", UPDATES).drop("batch_id")
    mine = settlements.select(*names(SETTLEMENTS)).dropDuplicates(key).join(kept.select(*key), key, "left_anti").select(*names(SETTLEMENTS))
    mine = stored(mine)  # written and compared
    said = updates.select(*names(UPDATES)).distinct()
    touched = settlements.select(*EVENT_KEYS).union(said.select(*EVENT_KEYS)).distinct()
    was, had = kept.join(touched, EVENT_KEYS, "left_semi"), known.join(touched, EVENT_KEYS, "left_semi")
    cells, seen = deltas(_final(was, had), _final(was.unionByName(mine), had.unionByName(said)))
    return commit(root, batch_id, {"settlements": mine, "updates": said, "deltas": cells, "seen": seen}, move=("pulse", at, batch_id))


def state(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """DELTAS and SEEN of all batches added up."""
    cells = committed(spark, root, "deltas", DELTAS).groupBy(*CELL).agg(F.sum("settlement_count").alias("settlement_count"), *[F.sum(c).cast("decimal(38,0)").alias(c) for c in LIMB_NAMES])
    seen = committed(spark, root, "seen", SEEN).groupBy(*CELL, "kind", "id").agg(F.sum("n").alias("n"))
    return cells.where("settlement_count <> 0"), seen.where("n <> 0")


def _amount(limbs: list[str]) -> F.Column:
    """The number that limbs make, as a canonical text; carries go up."""
    base = F.lit(10**LIMB).cast("decimal(38,0)")
    carry, out = F.lit(0).cast("decimal(38,0)"), []
    for c in reversed(limbs):
        whole = F.col(c) + carry
        out.append(F.lpad((whole % base).cast("decimal(18,0)").cast("string"), LIMB, "0"))
        carry = ((whole - whole % base) / base).cast("decimal(38,0)")
    return F.regexp_replace(F.concat(carry.cast("string"), *reversed(out)), "^0+(?=.)", "")


def pulse(spark: SparkSession, root: str, provenance: DataFrame) -> DataFrame:
    """The pulse as it is now, as readmodels.pulse has it. The provenance (namespace_id, provenance_id, observed_at) of all settlements must be there."""
    cells, seen = state(spark, root)
    buyers = seen.where("kind = 'buyer'").groupBy(*CELL).agg(F.count(F.lit(1)).alias("active_buyers"))
    at = provenance.select("namespace_id", F.col("provenance_id").alias("id"), "observed_at")
    proven = seen.where("kind = 'provenance'").join(at, ["namespace_id", "id"]).groupBy(*CELL).agg(F.max("observed_at").alias("observed_at"), joined_set("id").alias("provenance_ids"))
    rows = cells.join(proven, CELL).join(buyers, CELL, "left")
    return rows.select(*CELL, "settlement_count", F.coalesce("active_buyers", F.lit(0)).alias("active_buyers"), _amount(LIMB_NAMES).alias("amount_atomic"), "observed_at", "provenance_ids")
