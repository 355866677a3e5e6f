"""Quality rules: how much of a text lies in its own repeated n-grams and lines.

Texts are handled as bytes, many rows at once: word hashes come from prefix sums, the hashes of
n words roll from those of n - 1, and equal hashes of one text are found by sorting. Nothing is
shuffled; memory is bounded by a slice of about a megabyte of text, or by one longer text.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.base import Prefixes, mix, slices, table, utf8, words

#: Most share of a text's word characters in repeated n-grams, by n.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Most share of lines equal to an earlier one, and of word characters in them.
LINE_LIMIT, LINE_CHARS_LIMIT = 0.30, 0.20
#: Most symbols a word.
SYMBOL_LIMIT = 0.1
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "dup_line_chars", "n_repeat_words")


def _twice(keys: np.ndarray) -> np.ndarray:
    """The values that occur more than once."""
    s = np.sort(keys)
    return s[1:][s[1:] == s[:-1]]


def measure(data: np.ndarray, offsets: np.ndarray, sizes: tuple[int, ...]) -> dict[str, np.ndarray]:
    """Counts for each row: MEASURES and, for each n of sizes, the word characters in repeated n-grams."""
    rows = len(offsets) - 1
    starts, ends, row = words(data, offsets)
    count = lambda at, weights=None: np.bincount(at, weights, rows).astype(np.int64)
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    inked = np.concatenate(([0], np.cumsum(np.bincount(starts, minlength=len(data))[: len(data)]))) if len(data) else np.zeros(1, np.int64)
    prefixes = Prefixes(data)
    chars = points[ends] - points[starts]
    hashes = prefixes.of(starts, ends)
    salt = mix(np.arange(1, rows + 1, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB))
    out = {"n_words": count(row), "word_chars": count(row, chars)}
    marks = np.flatnonzero(SYMBOLS[data])
    out["n_symbols"] = count(np.searchsorted(offsets, marks, "right") - 1)

    rolled = hashes
    for n in range(2, max(sizes) + 1):
        rolled = rolled[:-1] * np.uint64(0x8CB92BA72F3D8DD7) + hashes[n - 1 :] if len(rolled) > 1 else rolled[:0]
        if n not in sizes:
            continue
        inside = np.flatnonzero(row[: len(rolled)] == row[n - 1 :]) if len(rolled) else np.zeros(0, np.int64)
        keys = mix(rolled[inside] ^ salt[row[inside]])
        again = _twice(keys)
        covered = np.zeros(len(row) + 1, np.int64)
        if len(again):
            hit = inside[np.isin(keys, again)]
            covered[hit] += 1
            covered[hit + n] -= 1
        covered = np.cumsum(covered)[: len(row)] > 0
        out[f"chars_{n}"] = count(row, chars * covered)
        if n == 3:
            out["n_repeat_words"] = count(row, covered)

    breaks = np.flatnonzero(data == 10)
    per_row = np.bincount(np.searchsorted(offsets, breaks, "right") - 1, minlength=rows) + 1
    line_row = np.repeat(np.arange(rows), per_row)
    line_start = np.sort(np.concatenate((offsets[:-1], breaks + 1)))
    line_end = np.sort(np.concatenate((breaks, offsets[1:])))
    said = np.flatnonzero(inked[line_end] > inked[line_start])
    keys = mix(prefixes.of(line_start[said], line_end[said]) ^ salt[line_row[said]])
    later = np.ones(len(said), bool)
    later[np.unique(keys, return_index=True)[1]] = False
    word_points = np.concatenate(([0], np.cumsum(chars)))
    first, last = np.searchsorted(starts, line_start[said]), np.searchsorted(starts, line_end[said])
    out["n_lines"] = count(line_row[said])
    out["n_dup_lines"] = count(line_row[said], later)
    out["dup_line_chars"] = count(line_row[said], (word_points[last] - word_points[first]) * later)
    return out


def measure_texts(docs: DataFrame, text: str = "text", sizes: tuple[int, ...] = tuple(NGRAM_LIMITS), keep: bool = False) -> DataFrame:
    """docs without text (keep: with it), with MEASURES and chars_<n>; columns of docs with these names are replaced.

    Null and empty texts measure 0; repeated rows are measured each; an empty table gives an empty result.
    """
    sizes = tuple(sorted({3, *sizes}))
    added = [*MEASURES, *(f"chars_{n}" for n in sizes)]
    kept = [c for c in docs.columns if c != text and c not in added]
    names = [*kept, text] if keep else kept
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names), *(f"{m} bigint" for m in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = utf8(batch.column(batch.num_columns - 1))
            parts = [measure(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], sizes) for i, j in slices(offsets)]
            found = [pa.array(np.concatenate([p[m] for p in parts])) for m in added]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *found], [*names, *added])

    return docs.select(*kept, F.col(text).alias(names[-1] if keep else "__text")).mapInArrow(run, schema)


def judge(
    measured: DataFrame,
    limits: Mapping[int, float] = NGRAM_LIMITS,
    line_limit: float = LINE_LIMIT,
    line_chars_limit: float = LINE_CHARS_LIMIT,
    symbol_limit: float = SYMBOL_LIMIT,
) -> DataFrame:
    """Adds base_failed (too short, or mostly repeated three-word windows), repetitive, symbolic and kept (none of them)."""
    repetitive = (F.col("n_dup_lines") > F.lit(line_limit) * F.col("n_lines")) | (F.col("dup_line_chars") > F.lit(line_chars_limit) * F.col("word_chars"))
    for n, most in sorted(limits.items()):
        repetitive |= F.col(f"chars_{n}") > F.lit(most) * F.col("word_chars")
    return (
        measured.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
        .withColumn("repetitive", repetitive)
        .withColumn("symbolic", F.col("n_symbols") > F.lit(symbol_limit) * F.col("n_words"))
        .withColumn("kept", ~F.col("base_failed") & ~F.col("repetitive") & ~F.col("symbolic"))
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that pass, with their columns; rows and ids may repeat."""
    inner = [f"__c{i}" for i in range(len(docs.columns))]  # names that can't clash with the measures
    named = docs.toDF(*inner)
    text = inner[docs.columns.index("text")]
    measured = judge(measure_texts(named, text, keep=True))
    return measured.where("kept").select(*[F.col(a).alias(b) for a, b in zip(inner, docs.columns, strict=True)])


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    judged = judge(measure_texts(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "dup_line_chars", "chars_5", "chars_10")
