"""Removal of byte strings that occur earlier in the corpus, with merged Burrows-Wheeler transforms.

1. Each window of `length` bytes has an anchor: the leftmost of its byte grams with the smallest
   hash. Equal windows have equal anchors at equal offsets, so the windows of a text fall into
   runs, one for each anchor, and only runs of equal anchors can share windows.
2. Runs with equal context (the bytes of all their windows, told by 128 bits of two independent
   hashes) are one string with copies: all but the earliest are removed. This is done in each task
   first, so that a hot passage leaves one record per task and copies aren't merged as strings.
   An anchor with very many contexts - at the edge of a passage that a great share of all documents
   has - is split: there each window is a run of its own, with its own hash as anchor.
3. The earliest run of each context, where an anchor has several contexts, is compared by its
   bytes: each shard of contexts gets a Burrows-Wheeler transform in a task of its own, and another
   task merges the transforms of a bucket's shards by iterative interleave refinement. After `length`
   rounds the interleave is sorted by as many bytes, and blocks of equal prefixes are the repeated
   intervals; no suffix of the union is sorted again. `repeated_intervals` goes on with the rounds and
   gives the common length of each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.base import Prefixes, Scratch, mix, sieved, stored, table

LENGTH, GRAM = 100, 32
#: Bytes handled at once (positions take the low 20 bits of a key), contexts and their bytes merged together, shards of them.
CHUNK, TOGETHER, TOGETHER_BYTES, SHARDS = 1 << 19, 3000, 1 << 20, 4
#: Records held at once in a task; bytes of texts whose records make a task.
HELD, IN_TASK = 1 << 19, 16 << 20
#: Contexts from which an anchor is split, counted in tasks where it has so many; at most so many anchors
#: (the most frequent; which are split changes only how the work is dealt).
SPLIT, SEEN_IN_TASK, SPLIT_KEPT = 2000, 4, 100_000
RECORD = np.dtype([("anchor", "<u8"), ("context", "<u8"), ("check", "<u8"), ("doc", "<i8"), ("version", "<u4"), ("at", "<u4"), ("before", "u1"), ("last", "u1")])
SPAN = np.dtype([("doc", "<i8"), ("version", "<u4"), ("start", "<u4"), ("end", "<u4")])
LOW = np.uint64((1 << 20) - 1)


def runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM, split: np.ndarray = np.zeros(0, np.uint64)) -> tuple[np.ndarray, ...]:
    """Anchor position, first and last window start, anchor hash and two context hashes of each run of windows.

    Windows of anchors in split (sorted hashes) are runs of their own, anchored by themselves.
    """
    n = len(data)
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 3
    if n < length:
        return none
    prefixes = Prefixes(data)
    grams = np.arange(n - gram + 1)
    hashes = prefixes.of(grams, grams + gram)
    keys = (hashes & ~LOW) | grams.astype(np.uint64)
    width, have = length - gram + 1, 1
    low = keys
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
    ends = np.repeat(offsets[1:], np.diff(offsets))
    starts = np.flatnonzero(np.arange(len(low)) + length <= ends[: len(low)])
    if not len(starts):
        return none
    anchor = (low[starts] & LOW).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    at, p0, p1 = anchor[first], starts[first], starts[last]
    place = (((at - p0) << 8) | (at - p1)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    context = mix(prefixes.of(p0, p1 + length) ^ place)
    check = mix(_sums(data, p0, p1 + length) ^ place)
    anchor = hashes[at]
    if len(split):
        hot = split[np.minimum(np.searchsorted(split, anchor), len(split) - 1)] == anchor
        if hot.any():
            n = (p1 - p0 + 1)[hot]
            each = np.repeat(p0[hot] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            own = mix(prefixes.of(each, each + length) + np.uint64(0x51ED270B0A1F39C1))
            at, p0, p1 = (np.concatenate((x[~hot], each)) for x in (at, p0, p1))
            anchor, context = np.concatenate((anchor[~hot], own)), np.concatenate((context[~hot], own))
            check = np.concatenate((check[~hot], mix(_sums(data, each, each + length))))
    return at, p0, p1, anchor, context, check


#: Weights of a second, unrelated hash: an odd number for each byte value, and a base of its own.
_WEIGHTS = mix(np.arange(1001, 1257, dtype=np.uint64) * np.uint64(0x8CB92BA72F3D8DD7)) | np.uint64(1)
_STEP = 0xB5297A4D3F84D5B5


def _sums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The second hash of byte ranges, by prefix sums as the first one."""
    up, down = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_WEIGHTS[data] * up[: len(data)], out=sums[1:])
    return (sums[ends] - sums[starts]) * down[starts]


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    n = CHUNK + (1 << 12)
    out = []
    for base in (_STEP, pow(_STEP, -1, 1 << 64)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _tables()
    assert n < len(up), "a chunk is at most CHUNK bytes and a window"
    return up, down


def records_of(docs: list[int], texts: list[bytes], length: int = LENGTH, split: np.ndarray = np.zeros(0, np.uint64)) -> np.ndarray:
    """Records of all runs of texts; long texts are handled in overlapping chunks."""
    out, chunk, owner, base, size = [], [], [], [], 0
    versions = [zlib.crc32(t) for t in texts]

    def flush():
        nonlocal size
        if chunk:
            offsets = np.concatenate(([0], np.cumsum([len(c) for c in chunk])))
            at, p0, p1, anchor, context, check = runs(np.frombuffer(b"".join(chunk), np.uint8), offsets, length, split=split)
            row = np.searchsorted(offsets, p0, "right") - 1
            r = np.empty(len(at), RECORD)
            r["anchor"], r["context"], r["check"] = anchor, context, check
            r["doc"], r["version"] = np.array([docs[i] for i in owner])[row], np.array([versions[i] for i in owner])[row]
            r["at"] = at - offsets[row] + np.array(base)[row]
            r["before"], r["last"] = at - p0, at - p1
            out.append(r)
        chunk.clear(), owner.clear(), base.clear()
        size = 0

    for i, t in enumerate(texts):
        for s in range(0, max(1, len(t) - length + 1), CHUNK):
            part = t[s : s + CHUNK + length - 1]
            if len(part) < length:
                continue
            if size + len(part) > CHUNK:
                flush()
            chunk.append(part), owner.append(i), base.append(s)
            size += len(part)
    flush()
    return np.concatenate(out) if out else np.zeros(0, RECORD)


def firsts(r: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The earliest record of each anchor and context, and the spans of the others."""
    order = np.argsort(r["context"])
    c = r["context"][order]
    again = np.zeros(len(r), bool)
    again[1:] = c[1:] == c[:-1]
    again[:-1] |= again[1:]
    alone, twice = r[order[~again]], r[order[again]]
    twice = twice[np.lexsort((twice["at"], twice["version"], twice["doc"], twice["check"], twice["context"], twice["anchor"]))]
    new = np.zeros(len(twice), bool)
    new[:1] = True
    for c in ("context", "check", "anchor"):
        new[1:] |= twice[c][1:] != twice[c][:-1]
    first = twice[new]
    own = first[np.cumsum(new) - 1]
    later = (twice["doc"] != own["doc"]) | (twice["version"] != own["version"]) | (twice["at"] != own["at"])  # not the same text seen again
    return np.concatenate((alone, first)), spans_of(twice[later], length)


def spans_of(r: np.ndarray, length: int = LENGTH) -> np.ndarray:
    s = np.empty(len(r), SPAN)
    s["doc"], s["version"] = r["doc"], r["version"]
    s["start"], s["end"] = r["at"] - r["before"], r["at"] - r["last"] + np.uint32(length)
    return joined(s)


def joined(s: np.ndarray) -> np.ndarray:
    """Spans of the same text that touch or overlap as one."""
    if not len(s):
        return s
    s = s[np.lexsort((s["start"], s["version"], s["doc"]))]
    text = np.ones(len(s), bool)
    text[1:] = (s["doc"][1:] != s["doc"][:-1]) | (s["version"][1:] != s["version"][:-1])
    group = np.cumsum(text)
    reach = np.maximum.accumulate(s["end"].astype(np.int64) + (group << 33)) - (group << 33)
    new = text.copy()
    new[1:] |= s["start"][1:] > reach[:-1]
    first = np.flatnonzero(new)
    out = s[first].copy()
    out["end"] = reach[np.append(first[1:], len(s)) - 1]
    return out


def shard_transform(symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order and Burrows-Wheeler transform of sorted strings that each end in 0, by prefix doubling over rotations."""
    n = len(symbols)
    own = np.repeat(np.arange(len(starts), dtype=np.int32), sizes)
    begin, size = starts[own], sizes[own]
    at = np.arange(n) - begin
    rank, step, most = symbols.astype(np.int64), 1, int(sizes.max())
    bits = 8 * symbols.itemsize
    while bits * step < 32:  # the first doublings need no sort: several symbols fit in a key
        rank = (rank << (bits * step)) | rank[begin + (at + step) % size]
        step *= 2
    order = np.argsort(rank)
    while True:
        k = rank[order]
        new = np.concatenate(([0], np.cumsum(k[1:] != k[:-1])))
        if step >= most or new[-1] == n - 1:
            break
        dense = np.empty(n, np.int64)
        dense[order] = new
        rank = dense * (n + 1) + dense[begin + (at + step) % size]
        order = np.argsort(rank)
        step *= 2
    # equal rotations of equal strings keep the strings' order
    order = order[np.argsort(new * n + order)]
    return order, symbols[begin[order] + (at[order] - 1) % size[order]]


def refine(transforms: list[np.ndarray], tracked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """After each round: where the tracked places of the shards (rows, one shard after the other) are, one symbol
    further to the front than before, in merged order; their blocks of equal prefixes; and which tracked ones they are.

    The places start in any interleave. Each round reads the symbols before them and deals them by
    symbol, stably, while each moves to the row of the longer suffix in its own shard: the interleave is
    then right for one symbol more. Places share a block as long as their symbols and the blocks they
    came from are the same; one that is alone in its block is alone for good, and isn't followed further,
    nor is one at the front of its string.
    """
    before = []
    for t in transforms:
        row = np.empty(len(t), np.int32)
        row[np.argsort(t, kind="stable")] = np.arange(len(t), dtype=np.int32)
        before.append(row + sum(map(len, before)))
    symbol, before = np.concatenate(transforms), np.concatenate(before)
    place, block, which = tracked.astype(np.int32), np.zeros(len(tracked), np.int32), np.arange(len(tracked), dtype=np.int32)
    r = 0
    while len(place):
        said = symbol[place]
        order = np.argsort(said, kind="stable")
        order = order[np.searchsorted(said[order], 1) :]  # 0: the front of a string
        place, came, which, said = before[place[order]], block[order], which[order], said[order]
        new = np.zeros(len(place), bool)
        new[:1] = True
        new[1:] = (said[1:] != said[:-1]) | (came[1:] != came[:-1])
        block = np.cumsum(new, dtype=np.int32)
        if r % 4 == 3:
            alone = new & np.append(new[1:], True)
            place, block, which = place[~alone], block[~alone], which[~alone]
        yield place, block, which
        r += 1


def merge_transforms(transforms: list[np.ndarray], tracked: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the tracked places are after so many rounds, and their blocks."""
    place = block = np.zeros(0, np.int32)
    for place, block, _ in islice(refine(transforms, tracked), rounds):
        pass
    return place, block


def transform_of(contexts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Burrows-Wheeler transform of a shard of contexts, and the context and offset of each of its rows.

    Symbols are byte values plus one, in one byte each unless the byte 255 occurs; 0 ends a context.
    """
    mine = sorted(range(len(contexts)), key=contexts.__getitem__)
    sizes = np.array([len(contexts[i]) + 1 for i in mine])
    starts = np.cumsum(sizes) - sizes
    symbols = np.frombuffer(b"\0".join([contexts[i] for i in mine]) + b"\0", np.uint8).astype(np.uint16) + np.uint16(1)
    symbols[starts + sizes - 1] = 0
    order, transform = shard_transform(symbols, starts, sizes)
    owner = np.repeat(np.arange(len(mine)), sizes)[order]
    narrow = "<u1" if not len(transform) or transform.max() < 256 else "<u2"
    return transform.astype(narrow).tobytes(), np.array(mine, np.int32)[owner], (order - starts[owner]).astype(np.int32)


def _narrow(x: np.ndarray) -> bytes:
    return x.astype("<u2" if not len(x) or x.max() < 1 << 16 else "<u4").tobytes()


def _wide(raw: bytes, n: int) -> np.ndarray:
    """n numbers of one, two or four bytes each."""
    return np.frombuffer(raw, f"<u{max(1, len(raw) // max(1, n))}").astype(np.int64)


def repeated_starts(shards: list[tuple[bytes, np.ndarray, np.ndarray]], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Windows that an earlier context has too, as context and start, from the shards' transforms.

    Contexts of all shards are numbered by rank: the earlier one has the smaller number.
    """
    if not shards:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    transforms = [_wide(t, len(o)).astype(np.uint16) for t, o, _ in shards]
    owner, offset = np.concatenate([o for _, o, _ in shards]), np.concatenate([x for _, _, x in shards])
    # the ends of whole windows: `length` symbols before them the windows start
    place, block = merge_transforms(transforms, np.flatnonzero(offset >= length), length)
    context, offset = owner[place].astype(np.int64), offset[place].astype(np.int64)
    if not len(block):
        return context, offset
    first = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
    earliest = np.repeat(np.minimum.reduceat(context, first), np.diff(np.append(first, len(block))))
    later = context > earliest
    return context[later], offset[later]


def repeated_intervals(contexts: list[bytes], length: int = LENGTH, shards: int = SHARDS) -> list[tuple[int, int, int]]:
    """Strings of at least `length` bytes that end where a window of another context, or another one of the same, ends too.

    (context, start, common length): the longest string that ends there and occurs twice or more. Rounds of the merge
    go on until every place is alone, so the common lengths follow from how long a place had company.
    """
    parts = [list(range(s, len(contexts), shards)) for s in range(min(shards, len(contexts)))]
    made = [transform_of([contexts[i] for i in mine]) for mine in parts]
    if not made:
        return []
    owner = np.concatenate([np.array(mine)[o] for mine, (_, o, _) in zip(parts, made, strict=True)])
    offset = np.concatenate([x for _, _, x in made])
    ends = np.flatnonzero(offset >= length)
    common = np.zeros(len(ends), np.int64)
    for n, (_, block, which) in enumerate(refine([_wide(t, len(o)).astype(np.uint16) for t, o, _ in made], ends), 1):
        same = block[1:] == block[:-1]
        company = np.append(same, False) | np.insert(same, 0, False) if len(block) else same
        common[which[company]] = n
    found = np.flatnonzero(common >= length)
    return sorted(zip(owner[ends[found]].tolist(), (offset[ends[found]] - common[found]).tolist(), common[found].tolist(), strict=True))


def _deal(r: np.ndarray, parts: int) -> Iterator[tuple[int, bytes]]:
    bucket = (mix(r["anchor"]) >> np.uint64(40)).astype(np.int64) % parts
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(parts + 1))
    for b in np.flatnonzero(np.diff(cuts)):
        yield int(b), r[order[cuts[b] : cuts[b + 1]]].tobytes()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema) if rows else pa.RecordBatch.from_pylist([], schema)


DEALT = pa.schema([("bucket", pa.int32()), ("spans", pa.bool_()), ("data", pa.binary())])
FOUND = pa.schema([("doc", pa.int64()), ("version", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("anchor", pa.int64()), ("at", pa.int64())])


def frequent_anchors(rows: DataFrame, length: int = LENGTH) -> np.ndarray:
    """Hashes of the anchors that have very many contexts in the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray]] = []

        def counted() -> pa.RecordBatch:
            a, c = (np.concatenate(x) for x in zip(*kept, strict=True))
            kept.clear()
            a, n = np.unique(_pairs(a, c)[0], return_counts=True)
            a, n = a[n >= SEEN_IN_TASK], n[n >= SEEN_IN_TASK]
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(n)], ["anchor", "n"])

        for batch in batches:
            for s in range(0, batch.num_rows, 1000):
                part = batch.slice(s, 1000)
                r = records_of([0] * part.num_rows, [t or b"" for t in part.column(0).to_pylist()], length)
                kept.append(_pairs(r["anchor"], r["context"]))
                if sum(len(a) for a, _ in kept) > 2 * HELD:
                    yield counted()
        if kept:
            yield counted()

    counted = rows.select("text").mapInArrow(count, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") >= SPLIT)
    found = [r[0] for r in counted.orderBy(F.desc("n"), "anchor").limit(SPLIT_KEPT).collect()]
    return np.sort(np.array(found, np.int64).view(np.uint64))


def _pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs; b is a hash that hardly two values of a share."""
    _, at = np.unique(b, return_index=True)
    return a[at], b[at]


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc, version (CRC-32 of the bytes), start and end of bytes covered by strings that start earlier.

    docs has doc_id (null: before all) and text (null: empty). Rows that share doc_id and text are one
    text; those that share doc_id only rank by version. Spans may touch or overlap.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // IN_TASK), 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []

        def out() -> Iterator[pa.RecordBatch]:
            if not kept:
                return
            own, spans = firsts(np.concatenate(kept), length)
            kept.clear()
            rows = [(b, False, d) for b, d in _deal(own, parts)]
            step = max(1, -(-len(spans) // parts))
            rows += [(i, True, spans[i * step : (i + 1) * step].tobytes()) for i in range(-(-len(spans) // step))]
            for s in range(0, len(rows), 64):
                yield _batch(rows[s : s + 64], DEALT)

        for batch in batches:
            for s in range(0, batch.num_rows, 1000):
                part = batch.slice(s, 1000)
                kept.append(records_of(part.column(0).to_pylist(), [t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()], length, split))
                if sum(map(len, kept)) > HELD:
                    yield from out()
        yield from out()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, known = [], []
        for batch in batches:
            for is_span, d in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                (known if is_span else kept).append(np.frombuffer(d, SPAN if is_span else RECORD))
        if kept:
            r = np.concatenate(kept)
            kept.clear()
            order = np.argsort(r["anchor"])
            a = r["anchor"][order]
            again = np.zeros(len(r), bool)
            again[1:] = a[1:] == a[:-1]
            again[:-1] |= again[1:]
            r, later = firsts(r[order[again]], length)
            known.append(later)
            order = np.argsort(r["anchor"])
            a = r["anchor"][order]
            again = np.zeros(len(r), bool)
            again[1:] = a[1:] == a[:-1]
            again[:-1] |= again[1:]
            r = r[order[again]]
            for s in range(0, len(r), 20_000):
                x = r[s : s + 20_000]
                start, end = x["at"].astype(np.int64) - x["before"], x["at"].astype(np.int64) - x["last"] + length
                yield pa.RecordBatch.from_arrays([pa.array(x["doc"]), pa.array(x["version"].astype(np.int64)), pa.array(start), pa.array(end), pa.array(x["anchor"].view(np.int64)), pa.array(x["at"].astype(np.int64))], schema=FOUND)
        if known:
            x = joined(np.concatenate(known))
            for s in range(0, len(x), 20_000):
                y = x[s : s + 20_000]
                none = pa.nulls(len(y), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(y["doc"]), *(pa.array(y[c].astype(np.int64)) for c in ("version", "start", "end")), none, none], schema=FOUND)

    kind = "doc long, version long, start long, end long, anchor long, at long"
    rows = docs.select(_key(F.col("doc_id")).alias("doc"), F.col("text").cast("binary").alias("text"))
    split = frequent_anchors(rows, length)
    dealt = rows.mapInArrow(deal, "bucket int, spans boolean, data binary")
    found = stored(dealt.repartition(parts, "bucket").mapInArrow(settle, kind))
    return found.where("anchor is null").select("doc", "version", "start", "end").unionByName(_compared(rows, found.where("anchor is not null"), length))


def _key(doc_id) -> F.Column:
    return F.coalesce(doc_id.cast("long"), F.lit(-(2**63)))


SHARD = "bucket int, shard int, doc array<long>, version array<long>, at array<long>, start array<long>, transform binary, owner binary, offset binary, rows long"


def _compared(rows: DataFrame, asked: DataFrame, length: int) -> DataFrame:
    """Spans found by comparing the bytes of the asked contexts: transforms by shard, merged by bucket."""
    n, size = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0))).first()
    groups = max(1, -(-n // TOGETHER), -(-size // TOGETHER_BYTES))
    by_text = asked.groupBy("doc").agg(F.collect_list(F.struct("version", "start", "end", "anchor", "at")).alias("asked"))
    texts, _ = sieved(rows, "doc", by_text.select("doc"), asked.select("doc").distinct().count())
    with_text = texts.join(by_text, "doc").select("doc", "text", "asked")
    cut_schema = pa.schema([("bucket", pa.int32()), ("shard", pa.int32()), ("doc", pa.int64()), ("version", pa.int64()), ("at", pa.int64()), ("start", pa.int64()), ("context", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for d, t, asks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                t = t or b""
                version = zlib.crc32(t)
                for a in asks:
                    if a["version"] == version:
                        bucket = ((a["anchor"] * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 20) % groups
                        out.append((bucket, ((d * 31 + a["at"]) & 0xFFFFFFFF) % SHARDS, d, version, a["at"], a["start"], t[a["start"] : a["end"]]))
                if len(out) > 5000:
                    yield _batch(out, cut_schema)
                    out = []
            yield _batch(out, cut_schema)

    def transform(key: tuple, t: pa.Table) -> pa.Table:
        t = t.group_by(["doc", "version", "at", "start", "context"]).aggregate([]).sort_by([("doc", "ascending"), ("version", "ascending"), ("at", "ascending")])
        said, owner, offset = transform_of(t.column("context").to_pylist())
        lists = {c: pa.array([t.column(c).to_pylist()], pa.list_(pa.int64())) for c in ("doc", "version", "at", "start")}
        head = {"bucket": pa.array([key[0].as_py()], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int32())}
        return pa.table(head | lists | {"transform": pa.array([said], pa.binary()), "owner": pa.array([_narrow(owner)], pa.binary()), "offset": pa.array([_narrow(offset)], pa.binary()), "rows": pa.array([len(owner)], pa.int64())})

    def merge(t: pa.Table) -> pa.Table:
        own = [np.array([x for one in t.column(c).to_pylist() for x in one], np.int64) for c in ("doc", "version", "at", "start")]
        rank = np.empty(len(own[0]), np.int64)
        order = np.lexsort((own[2], own[1], own[0]))
        rank[order] = np.arange(len(order))
        first, shards = 0, []
        for docs, said, owner, offset, n in zip(*(t.column(c).to_pylist() for c in ("doc", "transform", "owner", "offset", "rows")), strict=True):
            shards.append((said, rank[first + _wide(owner, n)], _wide(offset, n)))
            first += len(docs)
        context, offset = repeated_starts(shards, length)
        row = order[context]
        s = np.empty(len(row), SPAN)
        s["doc"], s["version"], s["start"] = own[0][row], own[1][row], own[3][row] + offset
        s["end"] = s["start"] + np.uint32(length)
        s = joined(s)
        return pa.table({c: pa.array(s[c].astype(np.int64)) for c in ("doc", "version", "start", "end")})

    contexts = with_text.mapInArrow(cut, "bucket int, shard int, doc long, version long, at long, start long, context binary")
    shards = contexts.groupBy("bucket", "shard").applyInArrow(transform, SHARD)
    return shards.groupBy("bucket").applyInArrow(merge, "doc long, version long, start long, end long")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, spans (maximal removed byte runs: start, end) and kept (binary: the other bytes) of each row."""
    spans = stored(repeated_spans(docs.select("doc_id", "text"), length))
    by_text = spans.groupBy("doc").agg(F.collect_list(F.struct("version", "start", "end")).alias("spans"))
    rows = docs.select(_key(F.col("doc_id")).alias("doc"), "doc_id", F.col("text").cast("binary").alias("text"))
    touched, whole = sieved(rows, "doc", by_text.select("doc"), spans.select("doc").distinct().count())
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sizes, runs_, kept = [], [], []
                for t, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    t = t or b""
                    sizes.append(len(t))
                    version = zlib.crc32(t) if spans else 0
                    mine = sorted((x["start"], x["end"]) for x in spans or () if x["version"] == version)
                    whole: list[list[int]] = []
                    for a, b in mine:
                        if whole and a <= whole[-1][1]:
                            whole[-1][1] = max(whole[-1][1], b)
                        else:
                            whole.append([a, b])
                    pieces, p = [], 0
                    for a, b in whole:
                        pieces.append(t[p:a])
                        p = b
                    kept.append(b"".join([*pieces, t[p:]]) if whole else t)
                    runs_.append([{"start": a, "end": b} for a, b in whole])
                struct = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(runs_, struct), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    done = touched.join(by_text, "doc", "left").select("doc_id", "text", "spans").mapInArrow(apply, f"doc_id {id_type}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    text = F.coalesce("text", F.lit(b""))
    none = F.array().cast(done.schema["spans"].dataType)
    return done.unionByName(whole.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), none.alias("spans"), text.alias("kept")))


def op8_bwt_dedup(spark, sf_dir: str) -> DataFrame:
    done = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
