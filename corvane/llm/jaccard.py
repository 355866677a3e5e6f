"""N-gram Jaccard join: groups of documents whose word shingles overlap enough.

1. Documents with equal shingle sets are one class, told by a 128-bit digest.
2. Shingles are put in one order, rarest first, by the number of classes that have them. Of two sets
   that link, each has one of the other's shingles among its first n - ceil(t n) + 1: its prefix. A
   shingle that one class alone has ties nothing, so only classes whose other shingles reach into the
   prefix go on - as a rule those that are copied nearly whole. Classes that share a shingle of their
   prefixes are tied to the smallest of them - in the task first, then between tasks - so a shingle
   costs a row per task, never pairs. What hangs together is a neighbourhood.
   Shingles of very many classes are counted beforehand and aren't shuffled; they come last in order.
3. Inside a neighbourhood a T-occurrence search finds the links: the short inverted lists of a
   query are merged by counting, the long ones probed - the longest in bitmaps, the others by binary search -
   (DivideSkip), and what reaches the required overlap is a link. Classes that already hang together aren't compared again.
   Large neighbourhoods are dealt to blocks by size and a salt, each with a hub of its sizes; only classes
   outside the neighbourhood's main group are then searched for in the blocks of sizes they can link with, among the
   classes at home there: those that ask in a block don't meet each other in every block.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.base import Prefixes, Scratch, mix, sized, slices, stored, table, utf8, words
from corvane.llm.graph import components

#: Classes and shingles of a neighbourhood searched in one task; classes dealt to one task where neighbourhoods are small.
BLOCK, BLOCK_SHINGLES, TOGETHER = 600, 1 << 20, 300
#: Entries of inverted lists read and merged at once.
MERGED = 1 << 18
#: Sets probed in the long lists at once.
PROBED = 1 << 10
#: Pieces, a power of two, in which the ties of a task are made.
PIECES = 8
#: Shingles of classes handled in one task, and dealt out or counted at once.
IN_TASK, AT_ONCE = 1 << 20, 1 << 20
#: Shingles of at least so many classes aren't shuffled; at most so many of them, the most frequent (any choice
#: finds all links; it only keeps lists short), seen so often in one task.
FREQUENT, FREQUENT_KEPT, SEEN_IN_TASK = 64, 100_000, 3
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """For each text the sorted hashes of its distinct shingles of `size` words; A-Z are lower-cased.

    Fewer words make one shingle, no words none.
    """
    for begin in range(0, len(column), 1000):
        yield from _shingles(*utf8(column.slice(begin, 1000)), size)


def _shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    for i, j in slices(offsets):
        part, at = LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
        starts, ends, row = words(part, at)
        hashes = Prefixes(part).of(starts, ends)
        cuts = np.searchsorted(row, np.arange(j - i + 1))
        rolled = hashes
        for n in range(2, size + 1):
            rolled = rolled[:-1] * np.uint64(0x8CB92BA72F3D8DD7) + hashes[n - 1 :] if len(rolled) > 1 else rolled[:0]
        rolled = mix(rolled)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b - a >= size:
                yield np.unique(rolled[a : b - size + 1])
            elif b > a:
                h = np.array([b - a], np.uint64)
                for k in range(a, b):
                    h = mix(h * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[k : k + 1])
                yield h
            else:
                yield np.zeros(0, np.uint64)


def digest(s: np.ndarray) -> bytes:
    """16 bytes: two independent sums over a set."""
    with np.errstate(over="ignore"):
        a = mix(s ^ np.uint64(0x94D049BB133111EB)).sum(dtype=np.uint64) + np.uint64(len(s))
        b = mix(s * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(1)).sum(dtype=np.uint64)
    return a.astype(">u8").tobytes() + b.astype(">u8").tobytes()


def route(node: bytes) -> int:
    """The first 64 bits of a class's digest, by which it is routed to its neighbourhood."""
    return int.from_bytes(node[:8], "big", signed=True)


def least_overlap(n, percent: int):
    """Least intersection of a set of size n with any set it links with."""
    return -(-percent * n // 100)


def _merged(posting: np.ndarray, begin: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    """In how many of the lists each of n sets is; MERGED or so entries are merged at once."""
    times = np.zeros(n, np.int64)
    chunk = np.cumsum(size) // MERGED
    for i in np.split(np.arange(len(size)), np.flatnonzero(np.diff(chunk)) + 1):
        m = size[i]
        if total := int(m.sum()):
            times += np.bincount(posting[np.repeat(begin[i] - (np.cumsum(m) - m), m) + np.arange(total)], minlength=n)
    return times


def t_occurrence(tokens: np.ndarray, sizes: np.ndarray, labels: np.ndarray, asks: np.ndarray, percent: int, targets: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links between sets, enough of them to join what hangs together.

    tokens: the sets one after the other, of sizes tokens each. labels: what hangs together already (such sets aren't compared); asks: which sets are queries.
    targets: which sets are searched for, all if not given; two queries that aren't targets don't meet.
    """
    n = len(sizes)
    targets = np.ones(n, bool) if targets is None else targets
    target, place = np.flatnonzero(targets), np.cumsum(targets, dtype=np.int32) - 1
    n_targets, target_sizes = len(target), sizes[target]
    order = np.argsort(tokens, kind="stable").astype(np.int32)
    new = np.ones(len(tokens), bool)
    new[1:] = tokens[order[1:]] != tokens[order[:-1]]
    number = np.cumsum(new, dtype=np.int32) - 1
    token_id = np.empty(len(tokens), np.int32)
    token_id[order] = number
    posting = np.repeat(np.arange(n, dtype=np.int32), sizes)[order]  # lists one after the other, each in the order of the sets
    listed = targets[posting]
    posting, number = place[posting[listed]], number[listed]
    lengths = np.bincount(number, minlength=int(new.sum()))
    begin = np.cumsum(lengths) - lengths
    del order, new, listed
    # long lists, of a sixteenth of the targets or more, as bitmaps: at most sixteen bytes for each token
    row = np.full(len(lengths), -1, np.int32)
    wide = np.flatnonzero(lengths * 16 >= max(n_targets, 16))
    row[wide] = np.arange(len(wide), dtype=np.int32)
    bitmap = np.zeros((len(wide), n_targets), bool)
    of_wide = row[number] >= 0
    bitmap[row[number[of_wide]], posting[of_wide]] = True
    codes = number.astype(np.int64) * n_targets + posting
    at = np.cumsum(sizes) - sizes
    labels = labels.copy()
    members: dict[int, list[int]] = {}
    for i, x in enumerate(labels.tolist()):
        members.setdefault(x, []).append(i)
    open_ = np.ones(n_targets, bool)
    links = []
    for q in np.argsort(-sizes, kind="stable").tolist():
        if not asks[q] or not sizes[q]:
            continue
        if targets[q]:
            open_[place[q]] = False
        mine = token_id[at[q] : at[q] + sizes[q]]
        mine = mine[lengths[mine] > int(targets[q])]  # its own entry ties nothing
        least = -(-percent * int(sizes[q]) // 100)
        if len(mine) < least:
            continue
        # a target that asked has met the other targets already
        wanted = (open_ if targets[q] else True) & (labels[target] != labels[q]) & (target_sizes * 100 >= percent * sizes[q]) & (target_sizes * percent <= 100 * sizes[q])
        if not wanted.any():
            continue
        mine = mine[np.argsort(lengths[mine], kind="stable")]
        n_long = min(least - 1, int(least / (0.01 * math.log2(max(2, int(lengths[mine[-1]]))) + 1)))
        short, long = mine[: len(mine) - n_long], mine[len(mine) - n_long :]
        seen = _merged(posting, begin[short], lengths[short], n_targets)
        near = np.flatnonzero(wanted & (seen >= least - n_long))
        if not len(near):
            continue
        in_bitmap, others = row[long[row[long] >= 0]], long[row[long] < 0].astype(np.int64)
        for d_now in np.split(near, range(PROBED, len(near), PROBED)):
            both = seen[d_now]
            if len(in_bitmap):
                both = both + bitmap[np.ix_(in_bitmap, d_now)].sum(axis=0)
            if len(others) and len(codes):
                probe = others[:, None] * n_targets + d_now
                both = both + (codes[np.minimum(np.searchsorted(codes, probe), len(codes) - 1)] == probe).sum(axis=0)
            enough = 100 * both >= percent * (int(sizes[q]) + target_sizes[d_now] - both)
            for d in target[d_now[enough]].tolist():
                if labels[d] == labels[q]:
                    continue
                links.append((q, d))
                x, y = int(labels[q]), int(labels[d])
                if len(members[x]) < len(members[y]):
                    x, y = y, x
                labels[members[y]] = x
                members[x] += members.pop(y)
    return links


def _distinct(pairs: np.ndarray) -> np.ndarray:
    """The distinct columns of a two-row array, sorted."""
    pairs = pairs[:, np.lexsort((pairs[1], pairs[0]))]
    return pairs[:, np.concatenate(([True], (pairs[:, 1:] != pairs[:, :-1]).any(axis=0)))] if pairs.shape[1] else pairs


def _ties(got: Sequence, read: Callable[[Any], tuple[np.ndarray, np.ndarray]] = lambda x: x) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of (segments, classes) pairs: the smallest class of each segment, and the ties (class, smallest) of the others.

    One piece of the segments after the other, by their low bits, so that only a piece is sorted and
    unpacked at once.
    """
    for piece in range(PIECES if got else 0):
        picked = [(t[mine], c[mine]) for t, c in map(read, got) for mine in (t & (PIECES - 1) == piece,)]
        t, c = (np.concatenate(x) for x in zip(*picked, strict=True))
        del picked
        order = np.argsort(t)
        t, c = t[order], c[order]
        first = np.flatnonzero(np.concatenate((np.ones(min(len(t), 1), bool), t[1:] != t[:-1])))
        least = np.minimum.reduceat(c, first) if len(first) else c
        own = np.repeat(least, np.diff(np.append(first, len(t))))
        apart = c != own
        yield np.stack((t[first], least)), _distinct(np.stack((c[apart], own[apart])))


def _pack(values: np.ndarray, of: np.ndarray, more: np.ndarray | None = None) -> bytes:
    """Values by the class they belong to, each class once; more: a 32-bit number for each value."""
    order = np.argsort(of, kind="stable")
    values, of = values[order], of[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(len(of), 1), bool), of[1:] != of[:-1])))
    n = np.diff(np.append(first, len(of)))
    head = np.array([len(first), len(of)], "<i8").tobytes() + of[first].tobytes() + n.astype("<i4").tobytes() + values.tobytes()
    return head if more is None else head + more[order].astype("<u4").tobytes()


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    k, m = np.frombuffer(raw, "<i8", 2).tolist()
    of, n = np.frombuffer(raw, "<i8", k, 16), np.frombuffer(raw, "<i4", k, 16 + 8 * k)
    return np.frombuffer(raw, "<i8", m, 16 + 12 * k), np.repeat(of, n)


def _more(raw: bytes) -> np.ndarray:
    k, m = np.frombuffer(raw, "<i8", 2).tolist()
    return np.frombuffer(raw, "<u4", m, 16 + 12 * k + 8 * m)


def _bucket(values: np.ndarray, parts: int) -> np.ndarray:
    return (mix(values.view(np.uint64)) >> np.uint64(33)).astype(np.int64) % parts


def _cut(bucket: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket that isn't empty and where its rows are."""
    by = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[by], np.arange(parts + 1))
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        yield b, by[cuts[b] : cuts[b + 1]]


#: What a packed row holds: shingles to be counted, what is known of classes, shares of prefixes, finished ties.
SHINGLES, CLASSES, PREFIXES, TIES = range(4)
PACKED = "bucket int, kind int, data binary"


def _rows(found: Iterable[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for row in found:
        held.append(row)
        size += len(row[2])
        if size > 1 << 23 or len(held) == 2000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["bucket", "kind", "data"])
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["bucket", "kind", "data"])


def _tied(t: np.ndarray, c: np.ndarray, parts: int) -> Iterator[tuple[int, int, bytes]]:
    """Ties of a task: finished ones, and the smallest class of each shingle for the shingle's bucket."""
    found = list(_ties([(t, c)]))
    least, ties = np.concatenate([x[0] for x in found], axis=1), _distinct(np.concatenate([x[1] for x in found], axis=1))
    for b, at in _cut(_bucket(least[0], parts), parts):
        yield b, PREFIXES, _pack(least[0][at], least[1][at])
    if ties.shape[1]:
        for b, at in _cut(_bucket(ties[0], parts), parts):
            yield b, TIES, ties[:, at].tobytes()


def measured_classes(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, version, n, node) of each row, and (shingle, times) of shingles that many classes of a task have."""
    kind = docs.schema["doc_id"].dataType
    rows = docs.select("doc_id", F.xxhash64("text").alias("version"), "text")
    names = ["doc_id", "version", "n", "node", "shingle", "times"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: list[np.ndarray] = []
        seen: set[bytes] = set()

        def counted() -> Iterator[pa.RecordBatch]:
            if sets:
                t, n = np.unique(np.concatenate(sets), return_counts=True)
                t, n = t[n >= SEEN_IN_TASK].view(np.int64), n[n >= SEEN_IN_TASK]
                sets.clear(), seen.clear()
                for i in range(0, len(t), 50_000):
                    m = len(t[i : i + 50_000])
                    none = pa.nulls(m, pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.nulls(m, _arrow(kind)), none, none, pa.nulls(m, pa.binary()), pa.array(t[i : i + m]), pa.array(n[i : i + m])], names)

        held = 0
        for batch in batches:
            ns, nodes = [], []
            for s in shingle_sets(batch.column(2), size):
                node = digest(s)
                ns.append(len(s)), nodes.append(node)
                if len(s) and node not in seen:
                    seen.add(node)
                    sets.append(s)
                    held += len(s)
            zero = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ns, pa.int64()), pa.array(nodes, pa.binary()), zero, zero], names)
            if held > AT_ONCE:
                held = 0
                yield from counted()
        yield from counted()

    return rows.mapInArrow(measure, f"doc_id {kind.simpleString()}, version long, n long, node binary, shingle long, times long")


def frequent_shingles(measured: DataFrame) -> np.ndarray:
    """The most frequent shingles, the most frequent last."""
    often = measured.where("shingle is not null").groupBy("shingle").agg(F.sum("times").alias("times")).where(F.col("times") >= FREQUENT)
    kept = often.orderBy(F.col("times").desc(), "shingle").limit(FREQUENT_KEPT).select("shingle").collect()
    return np.array([r[0] for r in reversed(kept)], np.int64)


def ties(docs: DataFrame, size: int, percent: int, frequent: np.ndarray, parts: int) -> DataFrame:
    """(a, b) ties between routes of classes that share a shingle of their prefixes."""
    by_value = np.argsort(frequent)
    sorted_frequent = frequent[by_value]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shingles of classes to the shingles' buckets, sizes to the classes', prefixes of frequent ones tied."""
        seen: set[int] = set()
        rare: list[np.ndarray] = []
        common: list[tuple[np.ndarray, int]] = []
        known: list[tuple[int, int, int, int]] = []

        def out() -> Iterator[tuple[int, int, bytes]]:
            if known:
                info = np.array(known, np.int64)
                t, c = np.concatenate(rare), np.repeat(info[:, 0], info[:, 3])
                for b, at in _cut(_bucket(t, parts), parts):
                    yield b, SHINGLES, _pack(t[at], c[at])
                for b, at in _cut(_bucket(info[:, 0], parts), parts):
                    yield b, CLASSES, info[at, :3].tobytes()
            if common:
                t = np.concatenate([x for x, _ in common])
                yield from _tied(t, np.repeat(np.array([r for _, r in common], np.int64), [len(x) for x, _ in common]), parts)
            rare.clear(), common.clear(), known.clear()

        held = 0
        for batch in batches:
            for s in shingle_sets(batch.column(0), size):
                if not len(s):
                    continue
                r = route(digest(s))
                if r in seen:
                    continue
                seen.add(r)
                s = s.view(np.int64)
                often = np.zeros(len(s), bool)
                if len(frequent):
                    at = np.minimum(np.searchsorted(sorted_frequent, s), len(frequent) - 1)
                    often = sorted_frequent[at] == s
                    n_common = int(often.sum())
                    if n_common >= (least := least_overlap(len(s), percent)):
                        rank = by_value[at[often]]
                        common.append((s[often][np.argsort(rank)[: n_common - least + 1]], r))
                rare.append(s[~often])
                known.append((r, len(s), int(often.sum()), len(rare[-1])))
                held += len(s)
                if held > AT_ONCE:
                    held = 0
                    yield from _rows(out())
        yield from _rows(out())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shingles of two classes or more, with the number of classes, to the classes' buckets."""
        got = []
        for batch in batches:
            rest = pc.not_equal(batch.column(1), SHINGLES)
            if (passed := batch.filter(rest)).num_rows:
                yield passed
            got += map(_unpack, batch.filter(pc.invert(rest)).column(2).to_pylist())
        if not got:
            return
        t, c = (np.concatenate(x) for x in zip(*got, strict=True))
        got.clear()
        order = np.lexsort((c, t))
        t, c = t[order], c[order]
        del order
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (c[1:] != c[:-1])  # the same class from several tasks
        t, c = t[new], c[new]
        first = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
        n = np.diff(np.append(first, len(t)))
        times = np.repeat(n, n)
        t, c, times = t[times > 1], c[times > 1], times[times > 1]
        yield from _rows((b, SHINGLES, _pack(t[at], c[at], np.minimum(times[at], 2**32 - 1))) for b, at in _cut(_bucket(c, parts), parts))

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each class whose shingles reach into its prefix, the prefix's shared shingles, tied."""
        got, more, known = [], [], []
        for batch in batches:
            kinds = batch.column(1).to_numpy()
            rest = pa.array((kinds != SHINGLES) & (kinds != CLASSES))
            if (passed := batch.filter(rest)).num_rows:
                yield passed
            for kind, raw in zip(kinds.tolist(), batch.column(2).to_pylist(), strict=True):
                if kind == SHINGLES:
                    got.append(_unpack(raw)), more.append(_more(raw))
                elif kind == CLASSES:
                    known.append(np.frombuffer(raw, np.int64).reshape(-1, 3))
        if not got or not known:
            return
        t, c = (np.concatenate(x) for x in zip(*got, strict=True))
        times = np.concatenate(more)
        info = np.concatenate(known)
        order = np.lexsort((t, times, c))
        t, c = t[order], c[order]
        of, first, n = np.unique(c, return_index=True, return_counts=True)
        # sets that share a route, if ever, go by the smaller size and by the larger number of frequent shingles
        info = info[np.isin(info[:, 0], of)]
        info = info[np.lexsort((info[:, 1], info[:, 0]))]
        begin = np.searchsorted(info[:, 0], of)
        common = np.maximum.reduceat(info[:, 2], begin)
        taken = np.clip(n + common - least_overlap(info[begin, 1], percent) + 1, 0, n)
        inside = np.arange(len(t)) - np.repeat(first, n) < np.repeat(taken, n)
        if inside.any():
            yield from _rows(_tied(t[inside], c[inside], parts))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, open_ = [], []
        for batch in batches:
            for kind, raw in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                done.append(np.frombuffer(raw, np.int64).reshape(2, -1)) if kind == TIES else open_.append(raw)
        done += [ties for _, ties in _ties(open_, _unpack)]
        found = _distinct(np.concatenate(done, axis=1)) if done else np.zeros((2, 0), np.int64)
        for i in range(0, found.shape[1], 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(found[0, i : i + 50_000]), pa.array(found[1, i : i + 50_000])], ["a", "b"])

    dealt = docs.select("text").mapInArrow(deal, PACKED).repartition(parts, "bucket")
    counted = dealt.mapInArrow(count, PACKED).repartition(parts, "bucket")
    return counted.mapInArrow(narrow, PACKED).repartition(parts, "bucket").mapInArrow(settle, "a long, b long")


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


LINK = "a binary, b binary"


def _search(rows: DataFrame, percent: int) -> DataFrame:
    """Links found in each group (columns g1, g2) of rows (node, label, asks, home, shingles): of each that asks with those at home there."""

    def run(t: pa.Table) -> pa.Table:
        asks, home = (t.column(c).to_numpy(zero_copy_only=False) for c in ("asks", "home"))
        nodes = np.array(t.column("node").to_pylist(), dtype=object)
        labels = np.array(t.column("label").to_pylist(), dtype=object)
        kept: dict[bytes, int] = {}
        at_home = set(nodes[home])
        for i, node in enumerate(nodes):  # a class that asks stands for itself
            if node not in kept or asks[i] and not asks[kept[node]]:
                kept[node] = i
        if len(kept) < len(nodes):
            once = np.array(sorted(kept.values()))
            t, nodes, labels, asks = t.take(once), nodes[once], labels[once], asks[once]
        data = t.column("shingles").cast(pa.large_binary()).combine_chunks()
        data = data.chunk(0) if isinstance(data, pa.ChunkedArray) else data
        ends = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1] // 8
        tokens = np.frombuffer(data.buffers()[2], np.uint64, int(ends[-1]))[int(ends[0]) :]
        home = np.array([node in at_home for node in nodes], bool)
        number: dict[bytes, int] = {}
        small = np.array([number.setdefault(x, len(number)) for x in labels], np.int64)
        links = t_occurrence(tokens, np.diff(ends), small, asks, percent, home)
        return pa.table({"a": pa.array([nodes[a] for a, _ in links], pa.binary()), "b": pa.array([nodes[b] for _, b in links], pa.binary())})

    return rows.groupBy("g1", "g2").applyInArrow(run, LINK)


def _placed(docs: DataFrame, wanted: DataFrame, n_wanted: int, size: int) -> DataFrame:
    """wanted (node, area, kind, rep) with the shingles of each class, read from its representative's text."""
    place = ["node", "area", "kind"]

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [s.tobytes() for s in shingle_sets(part.column(3), size)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(sets, pa.binary())], [*place, "shingles"])

    chosen = wanted.select(*place, F.col("rep.doc_id").alias("__id"), F.col("rep.version").alias("__v"))
    asked = docs.join(sized(chosen, n_wanted), docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__v"))).select(*place, "text")
    return asked.mapInArrow(shingle, "node binary, area long, kind int, shingles binary")


def _links(placed: DataFrame, large: DataFrame, n_large: int, buckets: int, percent: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) inside the neighbourhoods of placed, enough of them to join what hangs together."""
    row = [F.col("node").alias("label"), F.lit(True).alias("asks"), F.lit(True).alias("home"), "shingles"]
    few = F.pmod(F.xxhash64("area"), F.lit(buckets)).alias("g2")
    if not n_large:
        return scratch.stored(_search(placed.select(F.lit(0).cast("long").alias("g1"), few, "node", *row), percent))
    sides = sized(large.select(F.col("area").alias("large_area")).distinct(), n_large)
    joined = placed.join(sides, F.col("area") == F.col("large_area"), "left")
    small = joined.where("large_area is null").select(F.lit(0).cast("long").alias("g1"), few, "node", *row)
    # a salt of each block: blocks are alike in classes and in shingles
    blocks = sized(large.select(F.col("area").alias("large_area"), F.col("kind").alias("large_kind"), "salts", "hub"), n_large)
    salt = F.pmod(F.xxhash64("node"), F.col("salts")).cast("int")
    group = [F.col("area").alias("g1"), F.xxhash64("kind", "salt").alias("g2"), "node"]
    inside = placed.join(blocks, (F.col("area") == F.col("large_area")) & (F.col("kind") == F.col("large_kind")))
    hubs = inside.where("node = hub").select("node", "area", "shingles", F.col("kind").alias("from_kind"))
    # the hub of a kind stands in all blocks of its own and of the next kind
    hub_in = hubs.join(blocks, (F.col("area") == F.col("large_area")) & (F.col("large_kind") - F.col("from_kind")).between(0, 1))
    hub_in = hub_in.select("node", "area", "shingles", F.col("large_kind").alias("kind"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    in_blocks = inside.withColumn("salt", salt)
    first = scratch.stored(_search(small.unionByName(in_blocks.select(*group, *row)).unionByName(hub_in.select(*group, *row)), percent))
    groups = components(first, scratch.stored)
    named = inside.join(groups.withColumnRenamed("node", "key"), F.col("node") == F.col("key"), "left")
    labelled = scratch.stored(named.select("node", "area", "kind", "shingles", "salts", F.coalesce("component", "node").alias("label")))
    main = labelled.groupBy("area", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("area").agg(F.max_by("label", F.struct("n", "label")).alias("main")).withColumnRenamed("area", "main_area")
    outside = labelled.join(sized(main, n_large), F.col("area") == F.col("main_area")).where("label <> main").select("node", "area", "shingles", "label", F.col("kind").alias("own_kind"))
    # who isn't in the main group asks in every block of sizes it can link with
    asked = outside.join(blocks, (F.col("area") == F.col("large_area")) & F.abs(F.col("large_kind") - F.col("own_kind")).between(0, 1))
    asked = asked.select("node", "area", "shingles", "label", F.col("large_kind").alias("kind"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    asking = asked.select(*group, "label", F.lit(True).alias("asks"), F.lit(False).alias("home"), "shingles")
    members = labelled.withColumn("salt", salt).select(*group, "label", F.lit(False).alias("asks"), F.lit(True).alias("home"), "shingles")
    wanted = asking.select("g1", "g2").distinct()
    second = _search(members.join(wanted, ["g1", "g2"], "left_semi").unionByName(asking), percent)
    return scratch.stored(first.unionByName(second))


def jaccard_groups(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, version (hash of the text), n_shingles and component_id of each row of docs (doc_id, text).

    component_id is the smallest doc_id (nulls apart) among documents that hang together by links. Null, empty and
    blank texts link with nothing. Rows may repeat; an empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text")
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        measured = scratch.stored(measured_classes(docs, size))
        members = measured.where("shingle is null").select("doc_id", "version", "n", "node")
        frequent = frequent_shingles(measured)
        shingles = members.agg(F.sum("n")).first()[0] or 0
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-shingles // IN_TASK), 1)
        near = scratch.stored(components(ties(docs, size, percent, frequent, parts), scratch.stored).select(F.col("node").alias("key"), F.col("component").alias("area")))
        reps = members.where("n > 0").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "version")).alias("rep"), F.max("n").cast("long").alias("n"))
        reps = scratch.stored(reps)
        key = F.conv(F.hex(F.substring("node", 1, 8)), 16, -10).cast("long")
        # sizes that can link are of the same or of neighbouring kinds
        kind = F.floor(F.log(F.col("n")) / F.lit(math.log(100.1 / percent))).cast("int")
        wanted = scratch.stored(reps.withColumn("key", key).join(near, "key").select("node", "area", "n", kind.alias("kind"), "rep"))
        n_wanted, n_shingles = wanted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        buckets = max(1, -(-n_wanted // TOGETHER), -(-n_shingles // BLOCK_SHINGLES))
        by_area = wanted.groupBy("area").agg(F.count(F.lit(1)).alias("classes"), F.sum("n").alias("shingles")).where((F.col("classes") > BLOCK) | (F.col("shingles") > BLOCK_SHINGLES))
        by_area = scratch.stored(by_area.select(F.col("area").alias("large_area")))
        n_areas = by_area.count()
        inside = wanted.join(sized(by_area, n_areas), F.col("area") == F.col("large_area"))
        salts = F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)), F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES))).cast("int")
        large = scratch.stored(inside.groupBy("area", "kind").agg(salts.alias("salts"), F.min("node").alias("hub")))
        placed = scratch.stored(_placed(docs, wanted, n_wanted, size))
        groups = components(_links(placed, large, large.count(), buckets, percent, scratch), scratch.stored)
        roots = reps.join(groups.withColumnRenamed("node", "linked"), F.col("node") == F.col("linked"), "left").select("node", F.coalesce("component", "node").alias("component"), F.col("rep.doc_id").alias("id"))
        least = roots.groupBy("component").agg(F.min("id").alias("component_id"))
        named = roots.join(least, "component").select("node", "component_id")
        known = members.where("n > 0").join(named, "node").select("doc_id", "version", F.col("n").alias("n_shingles"), "component_id")
        blank = members.where("n = 0").select("doc_id", "version", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
        return stored(known.unionByName(blank))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The document with the smallest doc_id of each group, with all its columns; repeated rows stay once."""
    groups = jaccard_groups(docs, size, percent)
    # rows without an id are groups of their own
    group = F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("null:"), F.col("version").cast("string")))
    rows = groups.select("doc_id", "version", group.alias("group"))
    kept = rows.groupBy("group").agg(F.min_by(F.struct("doc_id", "version"), F.struct(F.col("doc_id").isNull(), "doc_id", "version")).alias("kept"))
    gone = stored(rows.join(kept, "group").where(F.struct("doc_id", "version") != F.col("kept")).select(F.col("doc_id").alias("__id"), F.col("version").alias("__v")).distinct())
    mine = docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__v"))
    found = docs.join(sized(gone, gone.count()), mine, "left_anti")
    if rows.groupBy("doc_id", "version").count().where("count > 1").isEmpty():
        return found
    packed = found.select("doc_id", F.xxhash64("text").alias("__v"), F.struct(*docs.columns).alias("__row"))
    return packed.dropDuplicates(["doc_id", "__v"]).select("__row.*")


def op10_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
