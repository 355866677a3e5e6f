"""Line dedup: boilerplate is what many sites say.

The spread of a line is its number of distinct sites. HyperLogLog sketches per line hash merge by
aggregation, so a hot line costs one sketch per task; lines whose estimate is near the threshold
get an exact distinct count. Of a boilerplate line only the first occurrence of the corpus stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.base import stored, table

#: Sites from which a line is boilerplate; share around it within which estimates aren't trusted; sketch size (log2).
SITES, MARGIN, LG_K = 5, 0.15, 12
BLANKS = " \t\r"


def _lines(docs: DataFrame, site: str, extra: list[str]) -> DataFrame:
    """One row for each line that isn't blank: site, pos, first (rank), h1 and h2 (hashes of the trimmed line)."""
    exploded = docs.select(F.col(site).cast("string").alias("site"), "doc_id", *extra, F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    line = F.btrim("line", F.lit(BLANKS))
    return exploded.where(line != "").select("site", "doc_id", *extra, "pos", F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(7), line).alias("h2"))


def boilerplate(docs: DataFrame, site: str = "source", sites: int = SITES, margin: float = MARGIN, lg_k: int = LG_K) -> DataFrame:
    """h1, h2 and first (doc_id, pos) of each line on at least `sites` distinct sites.

    A null site is no site. The error of a sketch of 2^12 registers is 1.6 % (one sigma): estimates
    beyond the margin are settled, the others counted exactly.
    """
    lines = _lines(docs, site, [])
    spread = lines.groupBy("h1", "h2").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("estimate"), F.min(F.struct("doc_id", "pos")).alias("first")
    )
    candidates = stored(spread.where(F.col("estimate") >= sites * (1 - margin)))
    near = candidates.where(F.col("estimate") <= sites * (1 + margin)).select("h1", "h2")
    exact = lines.join(near, ["h1", "h2"], "left_semi").groupBy("h1", "h2", "site").agg(F.lit(1).alias("one"))
    exact = exact.groupBy("h1", "h2").agg(F.count("site").alias("n_sites")).where(F.col("n_sites") >= sites).select("h1", "h2")
    sure = candidates.where(F.col("estimate") > sites * (1 + margin))
    return sure.select("h1", "h2", "first").unionByName(candidates.join(exact, ["h1", "h2"]).select("h1", "h2", "first"))


def dedup_lines(docs: DataFrame, site: str = "source", sites: int = SITES, **settings) -> DataFrame:
    """docs with n_lines, n_removed and text without boilerplate lines (joined by newlines again).

    Blank lines stay, null text stays null (0 lines), an empty text has one line. Of repeated rows
    with the first occurrence's doc_id each keeps its line. Other columns stay; columns with the
    result's names are replaced. An empty table gives an empty result.
    """
    docs = docs.drop("n_lines", "n_removed")
    version = F.xxhash64("text").alias("__version")  # rows that share a doc_id but not the text
    found = stored(boilerplate(docs, site, sites, **settings)).withColumnRenamed("first", "__first")
    lines = _lines(docs.select(F.col(site), "doc_id", "text", version), site, ["__version"])
    later = ~(F.col("doc_id").eqNullSafe(F.col("__first.doc_id")) & (F.col("pos") == F.col("__first.pos")))
    removed = (
        lines.join(found, ["h1", "h2"])
        .where(later)
        .groupBy(F.col("doc_id").alias("__id"), F.col("__version").alias("__v"))
        .agg(F.collect_set("pos").alias("__removed"))
    )
    joined = docs.join(removed, docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__v")), "left").drop("__id", "__v")
    return _rebuild(joined).select(*docs.columns, "n_lines", "n_removed")


def _rebuild(joined: DataFrame) -> DataFrame:
    lines: Column = F.split("text", "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__removed"))
    kept = F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    return (
        joined.withColumn("n_lines", F.coalesce(F.size(lines), F.lit(0)).cast("long"))
        .withColumn("n_lines", F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.col("n_lines")).cast("long"))
        .withColumn("n_removed", F.when(F.col("__removed").isNull(), F.lit(0)).otherwise(F.size("__removed")).cast("long"))
        .withColumn("text", F.when(F.col("__removed").isNull(), F.col("text")).otherwise(kept))
    )


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return done.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH cut AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, source, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM cut),
named AS (SELECT *, trim(line, chr(32) || chr(9) || chr(13)) AS said FROM lines),
wide AS (SELECT said, min((doc_id, pos)) AS first FROM named WHERE said <> '' GROUP BY said HAVING count(DISTINCT source) >= 5),
marked AS (SELECT n.doc_id, n.pos, n.line, w.said IS NOT NULL AND NOT (w.first = (n.doc_id, n.pos)) AS gone FROM named n LEFT JOIN wide w ON n.said = w.said),
built AS (SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_removed,
  coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
  length(CASE WHEN d.text IS NULL THEN NULL ELSE kept END)::BIGINT AS kept_chars,
  sha256(CASE WHEN d.text IS NULL THEN NULL ELSE kept END) AS kept_sha256
FROM documents d LEFT JOIN built b ON d.doc_id = b.doc_id
"""
