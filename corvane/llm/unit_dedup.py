"""Substring dedup by hashing lines and the sentences in them.

A unit is a line, or one of the sentences where a line has several; a line that repeats is a line whose sentences all do. Units of
every length are normalised and digested where their document lies; only digest, rank and place are stored and
shuffled. The earliest ranked occurrence of a digest stays, the others are removed. Partial aggregation leaves a hot digest one row per
task, a bitmap of the repeated digests spares all other units the join, and the join is split by Spark where one
digest has very many rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.base import WORD, Scratch, sieved, stored, table

#: Words that repeated units next to one another have together, at the least, for the query to remove them: stock phrases stand alone.
RUN_WORDS = 16
UNITS = "doc_id {id}, version bigint, unit int, line int, whole_line boolean, start int, length int, words int, digest binary"
#: A sentence ends in . ! or ?, closing quotes and brackets, and blanks; the last one with the line.
SENTENCE = r"""(?:.*?[.!?]["'”’»)\]]*[ \t]+)|.+$"""
_sentences, _words = re.compile(SENTENCE).findall, re.compile(WORD).findall


def normalise(unit: str) -> str:
    """Lower case, one space between words."""
    return " ".join(_words(unit.lower()))


def units_of(text: str) -> Iterator[tuple[int, int, bool, int, int, int, bytes]]:
    """Unit number, line number, whether it is a whole line, start and length in code points, words, MD5 of the normalised unit."""
    at, unit = 0, 0
    for k, line in enumerate(text.split("\n")):
        begins, pieces = at, _sentences(line)
        for piece in pieces:
            if said := _words(piece.lower()):
                whole = len(pieces) == 1
                yield unit, k, whole, begins, len(line) if whole else len(piece.rstrip(" \t")), len(said), hashlib.md5(" ".join(said).encode(), usedforsecurity=False).digest()
                unit += 1
            begins += len(piece)
        at += len(line) + 1


def text_units(docs: DataFrame) -> DataFrame:
    """The units of each row of docs (doc_id, text): columns as in UNITS, start and length in code points, version a hash of the text.

    Null, empty and blank texts have none; repeated rows have theirs each time; columns besides doc_id and text are let
    be; an empty table gives an empty result.
    """
    schema = UNITS.format(id=docs.schema["doc_id"].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                of, rows = [], []
                for i, t in enumerate(part.column(2).to_pylist()):
                    found = list(units_of(t)) if t else []
                    of.extend([i] * len(found))
                    rows.extend(found)
                cols = list(zip(*rows, strict=True)) if rows else [()] * 7
                own = pa.array(of, pa.int32())
                arrays = [part.column(0).take(own), part.column(1).take(own), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "version", "unit", "line", "whole_line", "start", "length", "words", "digest"])

    return docs.select("doc_id", F.xxhash64("text").alias("version"), "text").mapInArrow(run, schema)


def repeated_units(docs: DataFrame, run_words: int = 1) -> DataFrame:
    """Each unit of docs (doc_id, text) that an earlier one equals: its place, that of the first, and the words of its run.

    Rank is doc_id (null first), then a hash of the text, then unit. Rows with the same doc_id and text are one document seen again:
    their equal units share a rank, and none is removed for the other. A run is what repeated units next to one another in a document
    make; units whose runs have fewer than run_words words are left out (1: none is). Null, empty and blank texts have no units.
    """
    with Scratch(docs.sparkSession) as scratch:
        units = scratch.stored(text_units(docs))  # digests, not texts: extracted once, read twice
        rank = ["doc_id", "version", "unit"]
        firsts = units.groupBy("digest").agg(F.min(F.struct(*rank)).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("digest").alias("__digest"), "first")
        firsts = scratch.stored(firsts)
        maybe, _ = sieved(units, "digest", firsts.select("__digest"), firsts.count())
        place = ["line", "whole_line", "start", "length", "words", "digest"]
        later = maybe.join(firsts, F.col("digest") == F.col("__digest")).where(~F.struct(*rank).eqNullSafe(F.col("first")))
        once = later.select(*rank, *place, F.col("first.doc_id").alias("first_doc_id"), F.col("first.unit").alias("first_unit")).distinct()  # rows that repeat are alike in all
        document = Window.partitionBy("doc_id", "version")
        island = once.withColumn("__run", F.col("unit") - F.row_number().over(document.orderBy("unit")))
        runs = island.withColumn("run_words", F.sum("words").over(Window.partitionBy("doc_id", "version", "__run"))).where(F.col("run_words") >= run_words)
        return stored(
            runs.select("doc_id", "version", "unit", "line", "whole_line", "start", "length", F.hex("digest").alias("digest"), "first_doc_id", "first_unit", "run_words")
        )


def without_units(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """docs with the repeated units cut out of text; the columns stay as they are, whatever their names.

    Spans belong to doc_id and text: rows that share a doc_id but not the text are cut each by its own. Null texts stay null; rows that
    repeat are all cut; rows without a repeated unit are as before.
    """
    spans = repeated.groupBy(F.col("doc_id").alias("__id"), F.col("version").alias("__version")).agg(F.sort_array(F.collect_set(F.struct("start", "length"))).alias("__spans"))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("__of"), F.struct(*docs.columns).alias("__row"))
    joined = rows.join(spans, rows["doc_id"].eqNullSafe(F.col("__id")) & (F.col("__of") == F.col("__version")), "left")

    @F.pandas_udf("string")
    def cut(text, spans):
        import pandas as pd

        def one(t, s):
            if t is None or s is None:
                return t
            kept, at = [], 0
            for x in s:
                kept.append(t[at : x["start"]])
                at = x["start"] + x["length"]
            return "".join([*kept, t[at:]])

        return pd.Series([one(t, s) for t, s in zip(text, spans, strict=True)], dtype=object)

    texts = joined.select(cut("text", "__spans").alias("__text"), "__row")
    return texts.select(*[F.col("__text").alias("text") if c == "text" else F.col("__row")[c].alias(c) for c in docs.columns])


def op5_unit_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_units(table(spark, sf_dir, "documents").select("doc_id", "text"), RUN_WORDS).drop("version")


#: Sentences are found by the same pattern; offsets are running sums of lengths.
ORACLE = rf"""
WITH cut AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, unnest(ls) AS said, unnest(range(len(ls))) AS line FROM cut),
placed AS (SELECT *, (sum(length(said) + 1) OVER (PARTITION BY doc_id ORDER BY line))::BIGINT - length(said) - 1 AS begins FROM lines),
pieces AS (SELECT doc_id, line, begins, said AS whole, regexp_extract_all(said, '{SENTENCE.replace("'", "''")}') AS ps FROM placed),
parts AS (SELECT doc_id, line, begins, whole, len(ps) = 1 AS whole_line, unnest(ps) AS said, unnest(range(len(ps))) AS j FROM pieces),
sentences AS (SELECT *, begins + (sum(length(said)) OVER (PARTITION BY doc_id, line ORDER BY j))::BIGINT - length(said) AS start, regexp_extract_all(lower(said), '{WORD}') AS ws FROM parts),
units AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY line, j) - 1)::INTEGER AS unit, line::INTEGER AS line, whole_line, start::INTEGER AS start,
  length(CASE WHEN whole_line THEN whole ELSE rtrim(said, ' ' || chr(9)) END)::INTEGER AS length, len(ws) AS words, upper(md5(array_to_string(ws, ' '))) AS digest FROM sentences WHERE len(ws) > 0),
firsts AS (SELECT digest, min((doc_id, unit)) AS first FROM units GROUP BY digest HAVING count(*) > 1),
later AS (SELECT u.*, first[1] AS first_doc_id, first[2]::INTEGER AS first_unit, unit - row_number() OVER (PARTITION BY doc_id ORDER BY unit) AS island FROM units u JOIN firsts f ON u.digest = f.digest WHERE (u.doc_id, u.unit) <> first),
runs AS (SELECT *, (sum(words) OVER (PARTITION BY doc_id, island))::BIGINT AS run_words FROM later)
SELECT * EXCLUDE (words, island) FROM runs WHERE run_words >= {RUN_WORDS}
"""
