"""Fill-in-middle examples: texts cut at unit boundaries and put in another order.

Where unit k of a text begins is answered by a learned rank index: straight lines fitted to the offsets of all
boundaries, each as long as no boundary is more than ERROR code points off (or a piece of text is), and one byte for each boundary that says
how far off it is. A cut is predicted by its line and put right by its byte, so any number of cuts of a stored index
are exact without the text being split again. Rows are handled where they lie; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.base import table

# What a unit is, and the marks of the parts.
UNIT = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Farthest that a boundary is from its line (what fits a byte), boundaries looked at in one go, code points read at a time.
ERROR, LOOK, PIECE = 127, 512, 1 << 20
#: Texts of a hundred that are left plain, and of a hundred others that get the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20

LETTERS = np.zeros(128, bool)
LETTERS[65:91] = LETTERS[97:123] = True


def boundaries(text: str) -> Iterator[np.ndarray]:
    """The code points at which units end, in pieces of bounded size."""
    for at in range(0, len(text), PIECE):
        piece = text[at : at + PIECE + 1]  # one more, to see whether a run of letters goes on
        codes = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = (codes < 128) & LETTERS[np.minimum(codes, 127)]
        goes_on = letter[:-1] & letter[1:]
        if len(piece) <= PIECE:
            goes_on = np.append(goes_on, False)
        yield at + 1 + np.flatnonzero(~goes_on)


class RankIndex:
    """Offsets of the boundaries of a text: segments (first rank, its line's start and slope) and a residual byte each.

    Boundary 0 is the start of the text; boundary k the end of its k-th unit. n is the number of units.
    """

    def __init__(self, n: int, firsts: np.ndarray, starts: np.ndarray, slopes: np.ndarray, residuals: np.ndarray):
        self.n, self.firsts, self.starts, self.slopes, self.residuals = n, firsts, starts, slopes, residuals

    @classmethod
    def fit(cls, text: str, error: int = ERROR) -> RankIndex:
        firsts, starts, slopes, residuals = [], [], [], []
        rank, left = 0, np.zeros(1, np.int64)
        for piece in boundaries(text) if text else [np.zeros(0, np.int64)]:
            left = np.append(left, piece)
            while len(left):
                taken, slope = _line(left, error)
                firsts.append(rank)
                starts.append(int(left[0]))
                slopes.append(slope)
                residuals.append((left[:taken] - predicted(np.arange(taken), left[0], slope)).astype(np.int8))
                rank, left = rank + taken, left[taken:]
        return cls(rank - 1, np.array(firsts, np.int64), np.array(starts, np.int64), np.array(slopes), np.concatenate(residuals))

    def offset(self, rank: int) -> int:
        """The code point at which a unit ends: its segment's prediction, put right by the residual."""
        s = int(np.searchsorted(self.firsts, rank, "right")) - 1
        return int(predicted(rank - self.firsts[s], self.starts[s], self.slopes[s])) + int(self.residuals[rank])


def predicted(ranks, start, slope):
    return start + np.floor(slope * ranks).astype(np.int64)


def _line(offsets: np.ndarray, error: int) -> tuple[int, float]:
    """How many of the offsets lie within `error` of one line from the first on, and its slope.

    Each offset leaves a cone of slopes; the line goes on until the cones have nothing in common.
    """
    low, high, at = 0.0, np.inf, 1
    first, look = int(offsets[0]), LOOK
    room = error - 1  # rounding takes up to one
    while at < len(offsets):
        ranks = np.arange(at, min(len(offsets), at + look))
        rise = offsets[ranks] - first
        lows = np.maximum(low, np.maximum.accumulate((rise - room) / ranks))
        highs = np.minimum(high, np.minimum.accumulate((rise + room) / ranks))
        apart = np.flatnonzero(lows > highs)
        if len(apart):
            k = int(apart[0])
            if k:
                low, high = lows[k - 1], highs[k - 1]
            return at + k, _between(low, high)
        low, high, at, look = lows[-1], highs[-1], int(ranks[-1]) + 1, look * 2
    return len(offsets), _between(low, high)


def _between(low: float, high: float) -> float:
    return float(low if high == np.inf else (low + high) / 2)


def draws(doc_id) -> list[int]:
    """Four unsigned 32-bit numbers of a document."""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


def transform(doc_id, text: str, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> tuple[int, str, int | None, int | None, str]:
    """Number of units, form, code points of prefix and middle (None if plain), and the example made of a text."""
    index = RankIndex.fit(text)
    h1, h2, h3, h4 = draws(doc_id)
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= 100 - plain:
        return index.n, "plain", None, None, text
    first, second = sorted((h1 % (index.n + 1), h2 % (index.n + 1)))
    cut, end = index.offset(first), index.offset(second)
    prefix, middle, suffix = text[:cut], text[cut:end], text[end:]
    if h4 % 100 < suffix_first:
        return index.n, "spm", cut, end - cut, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return index.n, "psm", cut, end - cut, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restore(output: str, form: str) -> str:
    """The text of an example. No part holds a mark, and no mark can begin inside another, so the first ones count."""
    if form == "plain":
        return output
    one, two = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    head, rest = output.removeprefix(one).split(two, 1)
    tail, middle = rest.split(MIDDLE, 1)
    prefix, suffix = (head, tail) if form == "psm" else (tail, head)
    return prefix + middle + suffix


def fill_middle(docs: DataFrame, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of each row of docs (doc_id, text).

    plain and suffix_first are shares of a hundred. A null text is empty, an empty one plain with no unit; a null doc_id
    draws as no digits; rows that repeat come out alike; other columns are let be; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = [transform(d.as_py(), t.as_py() or "", plain, suffix_first) for d, t in zip(part.column(0), part.column(1), strict=True)]
                columns = [pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(examples: DataFrame) -> DataFrame:
    """The columns of examples with text, read back from output and form."""

    @F.pandas_udf("string")
    def back(output, form):
        import pandas as pd

        return pd.Series([restore(o, f) for o, f in zip(output, form, strict=True)], dtype=object)

    return examples.withColumn("text", back("output", "form"))


def rank_index(docs: DataFrame) -> DataFrame:
    """The index of each row of docs (doc_id, text), to be stored: doc_id, n, firsts, starts, slopes and residuals.

    A null or empty text has one boundary, its start.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [RankIndex.fit(t.as_py() or "") for t in part.column(1)]
                columns = [pa.array([x.n for x in found], pa.int64()), pa.array([x.firsts for x in found], pa.list_(pa.int64())), pa.array([x.starts for x in found], pa.list_(pa.int64()))]
                columns += [pa.array([x.slopes for x in found], pa.list_(pa.float64())), pa.array([x.residuals.tobytes() for x in found], pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", "n", "firsts", "starts", "slopes", "residuals"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n bigint, firsts array<bigint>, starts array<bigint>, slopes array<double>, residuals binary")


def offsets(index: DataFrame, ranks: str) -> DataFrame:
    """The columns of a stored index with offsets: the code points at which the units numbered in column `ranks` end.

    A number below 0 or above n gives null.
    """

    @F.pandas_udf("array<bigint>")
    def look_up(n, firsts, starts, slopes, residuals, asked):
        import pandas as pd

        out = []
        for row in zip(n, firsts, starts, slopes, residuals, asked, strict=True):
            x = RankIndex(row[0], *row[1:4], np.frombuffer(row[4], np.int8))
            out.append(None if row[5] is None else [x.offset(int(k)) if 0 <= k <= x.n else None for k in row[5]])
        return pd.Series(out)

    return index.withColumn("offsets", look_up("n", "firsts", "starts", "slopes", "residuals", ranks))


def op13_fill_middle(spark, sf_dir: str) -> DataFrame:
    made = fill_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c, 256)
    return restored(made).select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output").alias("output_sha256"), digest("text").alias("restored_sha256"))


#: Units as a list, cut by their number.
ORACLE = f"""
WITH said AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS h FROM documents),
drawn AS (SELECT doc_id, text, regexp_extract_all(text, '{UNIT}') AS units, ('0x' || h[1:8])::UBIGINT AS h1, ('0x' || h[9:16])::UBIGINT AS h2, ('0x' || h[17:24])::UBIGINT AS h3, ('0x' || h[25:32])::UBIGINT AS h4 FROM said),
placed AS (SELECT *, len(units)::BIGINT AS n, least(h1 % (len(units) + 1)::UBIGINT, h2 % (len(units) + 1)::UBIGINT)::BIGINT AS a, greatest(h1 % (len(units) + 1)::UBIGINT, h2 % (len(units) + 1)::UBIGINT)::BIGINT AS b,
  CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= {100 - PLAIN} THEN 'plain' WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT *, array_to_string(units[:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:], '') AS s FROM placed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM parts
"""
