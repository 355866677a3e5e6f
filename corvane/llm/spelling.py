"""Spelling variants: words one edit apart, grouped under the most frequent one.

Every possible edit of a word is probed against blocked Bloom filters of the vocabulary, one for each
word length; a filter has a counted size, is broadcast in passes of bounded size, and only edits that pass are
shuffled to the exact join with the vocabulary. An insertion in one word is a deletion in the other and
a replacement works both ways, so deletions and replacements by greater letters find every pair once.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.base import Scratch, mix, stored, table

RUN = "[A-Za-zÀ-ÿ]+"
#: Fewest code points and occurrences of a word; how many times as frequent the form of a word is at least.
LETTERS, OCCURRENCES, TIMES = 6, 5, 5
#: Every so many (document, run) pairs one is written with a letter left out.
DAMAGED = 199
#: Code points of a text handled at a time, and letters of distinct words that a task holds before it hands them on.
PIECE, HELD = 1 << 20, 4 << 20
#: Filter bits for each word, bits and lanes of a block, blocks of a stored row (4 KB), and bytes of the filters of a pass.
KEY_BITS, BLOCK_BITS, LANES, ROW_BLOCKS, PASS_BYTES = 16, 256, 8, 128, 32 << 20
#: Edits that a probe looks at in one go, and edits meant for one task.
PROBED, TASK_EDITS = 1 << 18, 40_000_000
#: Odd factors that turn one hash into a bit of each lane.
LANE_FACTORS = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1) ** 3 | 1) & (2**64 - 1) for i in range(LANES)], np.uint64)
BASE, UNBASE = np.uint64(0x5851F42D4C957F2D), np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))

_run = re.compile(RUN)
_lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def _pieces(text: str) -> Iterator[str]:
    """A text in pieces that end where a run does."""
    at = 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        if end < len(text) and _run.match(text, end - 1) and (rest := _run.match(text, end)):
            end = rest.end()
        yield text[at:end]
        at = end


def spelled(doc_id, run: str, damaged: int = DAMAGED) -> str:
    """A lower-cased run as it is counted: without one code point if its hash says so."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % damaged:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def count_words(docs: DataFrame, letters: int = LETTERS, occurrences: int = OCCURRENCES, damaged: int = DAMAGED) -> DataFrame:
    """word, n of the words with enough letters and occurrences in docs (doc_id, text).

    Null and empty texts have no runs; a null doc_id counts as no digits; rows that repeat count each time.
    """

    def packed(held: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        size = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                doc_id = doc_id.as_py()
                for piece in _pieces(text.as_py() or ""):
                    for said, n in Counter(_run.findall(piece)).items():
                        word = spelled(doc_id, said.lower() if said.isascii() else said.translate(_lower), damaged)
                        if len(word) < letters:
                            continue
                        if word not in held:
                            held[word], size = 0, size + len(word)
                        held[word] += n
                    if size > HELD:
                        yield packed(held)
                        held, size = {}, 0
        if held:
            yield packed(held)

    parts = docs.select("doc_id", "text").mapInArrow(run, "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


def shard_of(lengths: np.ndarray) -> np.ndarray:
    """The shard of words of a length: the length itself below 64, from there one for each power of two."""
    return np.where(lengths < 64, lengths, 58 + np.floor(np.log2(np.maximum(lengths, 1))).astype(np.int64))


def letters_of(words: list[str]) -> np.ndarray:
    """Words of one length as a matrix of their letters, which are all below U+0100."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def _powers(n: int) -> np.ndarray:
    p = np.full(n + 1, BASE, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


#: A random-looking number of each letter.
LETTER = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def raw_hashes(m: np.ndarray) -> np.ndarray:
    return (LETTER[m] * _powers(m.shape[1])[:-1]).sum(axis=1, dtype=np.uint64)


def bits_of(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each hash, and the hash that its bits come from."""
    h = mix(h)
    return ((h >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64), h


def lane_bit(h: np.ndarray, lane: int) -> np.ndarray:
    return (h * LANE_FACTORS[lane]) >> np.uint64(59)


def blocks_for(n: int) -> int:
    return max(8, -(-n * KEY_BITS // BLOCK_BITS))


#: Of each shard in a pass: blocks of its whole filter, the first that the pass holds, and the first that it doesn't.
Blocks = dict[int, tuple[int, int, int]]


def filter_rows(vocabulary: DataFrame, blocks: Blocks) -> DataFrame:
    """The filters of a pass as rows shard, part, bits of 4 KB."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.utf8_length(batch.column(0)).to_numpy(zero_copy_only=False)
            for length in np.unique(lengths):
                shard = int(shard_of(np.array([length]))[0])
                if shard not in blocks:
                    continue
                total, low, high = blocks[shard]
                words = batch.column(0).filter(pa.array(lengths == length)).to_pylist()
                step = max(1, PROBED // int(length))
                for at in range(0, len(words), step):
                    block, h = bits_of(raw_hashes(letters_of(words[at : at + step])), total)
                    mine = (block >= low) & (block < high)
                    block, h = block[mine] - low, h[mine]
                    bit = np.stack([block % ROW_BLOCKS * BLOCK_BITS + 32 * lane + lane_bit(h, lane).astype(np.int64) for lane in range(LANES)], 1).ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bit), shard, np.int32)), pa.array(np.repeat(block // ROW_BLOCKS, LANES)), pa.array(bit)], ["shard", "part", "bit"])

    rows = vocabulary.select("word").mapInArrow(places, "shard int, part bigint, bit bigint")
    return rows.groupBy("shard", "part").agg(F.bitmap_construct_agg("bit").alias("bits"))


def passes_of(sizes: dict[int, int], limit: int = PASS_BYTES) -> list[Blocks]:
    """Shards (words by shard) dealt to passes whose filters are at most `limit` bytes together; a large shard takes several."""
    most = max(1, limit * 8 // BLOCK_BITS // ROW_BLOCKS)  # rows of a pass
    out: list[Blocks] = []
    room = 0
    for shard, n in sorted(sizes.items()):
        total = blocks_for(n)
        low = 0
        while low < total:
            if not room:
                out.append({})
                room = most
            high = min(total, low + room * ROW_BLOCKS)
            out[-1][shard] = (total, low, high)
            room -= -(-(high - low) // ROW_BLOCKS)
            low = high
    return out


class Filters:
    """The filters of a pass; tells which hashes may be of words of a shard."""

    def __init__(self, blocks: Blocks, rows: list[tuple[int, int, bytes]]):
        self.blocks = blocks
        self.lanes = {s: np.zeros((-(-(high - low) // ROW_BLOCKS) * ROW_BLOCKS, LANES), np.uint32) for s, (_, low, high) in blocks.items()}
        for shard, part, bits in rows:
            self.lanes[shard][part * ROW_BLOCKS : (part + 1) * ROW_BLOCKS] = np.frombuffer(bits, "<u4").reshape(-1, LANES)

    def may_hold(self, shard: int, raw: np.ndarray) -> np.ndarray:
        """Places in raw of the hashes that pass."""
        total, low, high = self.blocks[shard]
        block, h = bits_of(raw, total)
        at, lanes = np.arange(len(raw)), self.lanes[shard]
        if high - low < total:
            mine = (block >= low) & (block < high)
            at, block, h = at[mine], block[mine] - low, h[mine]
        for lane in range(LANES):
            hit = (lanes[block, lane] >> lane_bit(h, lane).astype(np.uint32)) & np.uint32(1) != 0
            at, block, h = at[hit], block[hit], h[hit]
        return at


def edits_of(words: list[str], alphabet: np.ndarray, filters: Filters) -> Iterator[tuple[list[int], list[str]]]:
    """Places in words (of one length), and edits of them that pass the filters of a pass.

    Deletions (of equal letters in a row only the last) and replacements by a greater letter.
    """
    length = len(words[0])
    down, same = (int(s) for s in shard_of(np.array([length - 1, length])))
    powers = _powers(length)
    step = max(1, PROBED // length)
    for at in range(0, len(words), step):
        some = words[at : at + step]
        m = letters_of(some)
        terms = LETTER[m] * powers[:-1]
        whole = terms.sum(axis=1, dtype=np.uint64)
        if down in filters.blocks and length > 1:
            before = np.cumsum(terms, axis=1, dtype=np.uint64)  # up to and with each letter
            rest = before - terms + (whole[:, None] - before) * UNBASE
            last = np.ones(m.shape, bool)
            last[:, :-1] = m[:, :-1] != m[:, 1:]
            row, col = np.nonzero(last)
            hit = filters.may_hold(down, rest[row, col])
            yield [at + int(r) for r in row[hit]], [some[r][:c] + some[r][c + 1 :] for r, c in zip(row[hit].tolist(), col[hit].tolist(), strict=True)]
        if same in filters.blocks:
            for letter in alphabet:
                row, col = np.nonzero(m < letter)
                raw = whole[row] + (LETTER[letter] - LETTER[m[row, col]]) * powers[col]
                hit = filters.may_hold(same, raw)
                if len(hit):
                    new = chr(letter)
                    yield [at + int(r) for r in row[hit]], [some[r][:c] + new + some[r][c + 1 :] for r, c in zip(row[hit].tolist(), col[hit].tolist(), strict=True)]


def near_pairs(vocabulary: DataFrame, scratch: Scratch, limit: int = PASS_BYTES) -> DataFrame:
    """a, a_n, b, b_n: every two words of the vocabulary (word, n) one edit apart, once."""
    spark = vocabulary.sparkSession
    n_letters = F.length("word")
    lengths = vocabulary.groupBy(n_letters.alias("length")).agg(F.count(F.lit(1)).alias("n"))
    shard = F.when(F.col("length") < 64, F.col("length")).otherwise(58 + F.floor(F.log2("length"))).cast("int")
    # as many rows as there are shards: less than 64, and one for each power of two
    sizes = {r.shard: (r.n, r.edits) for r in lengths.groupBy(shard.alias("shard")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("length")).alias("edits")).collect()}
    said = vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct().where("c <> ''").collect()  # at most 256
    alphabet = np.array(sorted(ord(r.c) for r in said), np.uint8)
    tasks = max(1, -(-sum(e for _, e in sizes.values()) * max(1, len(alphabet)) // TASK_EDITS))
    words = vocabulary.repartition(int(tasks), "word")
    pairs = spark.createDataFrame([], "a string, a_n bigint, b string, b_n bigint")
    own = vocabulary.select(F.col("word").alias("b"), F.col("n").alias("b_n"))
    for blocks in passes_of({s: n for s, (n, _) in sizes.items()}, limit):
        rows = [(r.shard, r.part, bytes(r.bits)) for r in filter_rows(vocabulary, blocks).collect()]  # at most `limit` bytes
        shared = spark.sparkContext.broadcast((blocks, rows))

        def probe(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            filters = Filters(*shared.value)
            for batch in batches:
                lengths = pc.utf8_length(batch.column(0)).to_numpy(zero_copy_only=False)
                for length in np.unique(lengths):
                    part = batch.filter(pa.array(lengths == length))
                    a, n = part.column(0).to_pylist(), part.column(1).to_numpy(zero_copy_only=False)
                    for at, edits in edits_of(a, alphabet, filters):
                        yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in at], pa.string()), pa.array(n[at], pa.int64()), pa.array(edits, pa.string())], ["a", "a_n", "b"])

        found = words.select("word", "n").mapInArrow(probe, "a string, a_n bigint, b string")
        pairs = pairs.unionByName(scratch.stored(found.join(own, "b").select("a", "a_n", "b", "b_n")))
        shared.destroy()
    return pairs


def roots(forms: DataFrame, depth: int, scratch: Scratch) -> DataFrame:
    """word, root: where the forms (word, form) of each word end; depth is the most steps there are.

    The steps known of each word double with every round.
    """
    known = forms.select("word", F.col("form").alias("root"))
    steps = 1
    while steps < depth:
        known = scratch.stored(known)
        on = known.select(F.col("word").alias("root"), F.col("root").alias("further"))
        known = known.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
        steps *= 2
    return known


def variants(docs: DataFrame, letters: int = LETTERS, occurrences: int = OCCURRENCES, times: int = TIMES, damaged: int = DAMAGED, limit: int = PASS_BYTES) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of docs (doc_id, text).

    The form of a word is the most frequent of its near words (the smallest of equals) if it is `times` as
    frequent; the root is where forms lead. Null and empty texts have no words; a document's repeated rows count each
    time; other columns are let be; an empty table gives an empty result.
    """
    if times <= 1:
        raise ValueError("times must be above 1, or forms could lead in a circle")
    with Scratch(docs.sparkSession) as scratch:
        vocabulary = scratch.stored(count_words(docs, letters, occurrences, damaged))
        pairs = near_pairs(vocabulary, scratch, limit)
        both = pairs.select(F.inline(F.array(*[F.struct(F.col(x).alias("word"), F.col(f"{x}_n").alias("n"), F.col(y).alias("near"), F.col(f"{y}_n").alias("near_n")) for x, y in ("ab", "ba")])))
        best = both.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
        is_form = -F.col("best.less") >= times * F.col("n")
        near = scratch.stored(best.select("word", "n_near", F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")))
        most = vocabulary.agg(F.max("n")).first()[0] or 1
        depth = 1
        while occurrences * times**depth <= most:
            depth += 1
        ends = roots(near.where("form IS NOT NULL"), depth, scratch)
        done = vocabulary.join(near, "word", "left").join(ends, "word", "left")
        return stored(done.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"))


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents").select("doc_id", "text"))
