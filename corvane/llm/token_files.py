"""Token ids in files: length-limited canonical Huffman codes in independent blocks.

Ids are counted over the whole corpus, and one code, of at most LIMIT bits a word, is made of the counts. Documents are
coded where they lie, so that only code is shuffled, sorted by range partitioning, and each task writes blocks of whole
documents that can be decoded alone. A block notes the bits between every STRIDE-th id and the next: decoding begins at all these
checkpoints at once, by table. A block is a row of a Parquet table: Spark commits, splits and places the files, and they can
be read from any store.
"""

from __future__ import annotations

import json
import os
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.base import Scratch, on_exit, shared_dir, sized, slices, table, utf8
from corvane.llm.bpe import Bpe, default_vocabulary

#: The id after each document, longest code word in bits, ids between checkpoints, ids of a block (a longer document is one block).
END_ID, LIMIT, STRIDE, BLOCK_IDS = 1, 20, 64, 1 << 16
#: What a block begins with; then ids, documents, checkpoints and bytes of code (32 bits each), and the place of its first id in its part (64).
MAGIC = b"CVTOK1\0\0"
HEADER = struct.Struct("<8sIIIIQ")
#: Words that the library gets at a time, pieces that a worker remembers before it starts anew, bytes of text coded at a time (or one text).
JOINED, HELD, SLICE = 100, 1_000_000, 8 << 20
#: Marks that end a piece and are a word of their own after letters.
MARKS = frozenset(".,;:!?")
#: Ids of a piece, which begins at a byte; ids that are coded and decoded together; bytes of code meant for a task.
PIECE_IDS, TOGETHER, TASK_BYTES = 1 << 18, 1 << 20, 16 << 20


class LibraryBpe(Bpe):
    """Texts parted at white space; the library gives the ids of each piece that a worker hasn't met yet, many at a time.

    The vocabulary's words end in tokens of their own, by which the ids of joined words are parted again.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives each worker its core
        from tokenizers import Tokenizer

        super().__init__(path)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.ends = np.zeros(max(self.strings) + 1, bool)
        self.ends[[i for i, s in self.strings.items() if s.endswith(self.suffix)]] = True

    def learn(self, words: list[str]) -> None:
        """Has the ids of new words remembered."""
        groups = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        for group, said in zip(groups, self.library.encode_batch([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(said.ids, "<u4")
            last = np.flatnonzero(self.ends[ids]) + 1
            if len(last) == len(group) and len(ids) == last[-1]:
                raw, starts = ids.tobytes(), np.append(0, last[:-1])
                self.known.update((w, raw[4 * a : 4 * b]) for w, a, b in zip(group, starts.tolist(), last.tolist(), strict=True))
            else:
                self.known.update((w, np.array(self.library.encode(w, add_special_tokens=False).ids, "<u4").tobytes()) for w in group)

    def normal(self, text: str) -> str:
        """A text as the vocabulary has it."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # lower case letter by letter, without the rule for a word's last sigma
                text = text.replace("Σ", "σ")
        return text.lower()

    def plain(self, text: str) -> bool:
        """Whether white space parts a text's pieces and nothing else: no special token, no control character that is space to Arrow alone."""
        return not any(s in text for s in self.specials) and not any(c in text for c in "\x1c\x1d\x1e\x1f")

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and how many each has. Pieces are told apart by Arrow, so each is looked up once."""
        if len(self.known) >= HELD:
            self.known.clear()
        known = self.known
        odd = {i: np.frombuffer(self.encode(t), "<u4") for i, t in enumerate(texts) if not self.plain(t)}
        pieces = pc.utf8_split_whitespace(pa.array(["" if i in odd else self.normal(t) for i, t in enumerate(texts)], pa.large_string()))
        at = pieces.offsets.to_numpy()
        told = pieces.flatten().dictionary_encode()
        codes, names = told.indices.to_numpy(zero_copy_only=False), _listed(told.dictionary)
        said = list(map(known.get, names))
        new = {p: _parts(p, self.split) for p, ids in zip(names, said, strict=True) if ids is None}
        if new:
            self.learn(list({w: None for words in new.values() for w in words if w not in known}))
            for p, words in new.items():
                if len(words) != 1:
                    known[p] = b"".join([known[w] for w in words])
            said = list(map(known.__getitem__, names))
        sizes = np.fromiter(map(len, said), np.int64, len(said)) // 4
        starts, ids = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(said), "<u4")
        per = sizes[codes]
        ends = np.append(0, np.cumsum(per))
        found = ids[np.repeat(starts[codes] - ends[:-1], per) + np.arange(ends[-1])] if len(codes) else np.zeros(0, np.uint32)
        counts = np.diff(ends[at])
        if odd:
            parts, to = [], ends[at]
            for i in range(len(texts)):
                parts.append(odd.get(i, found[to[i] : to[i + 1]]))
            counts = np.array([len(x) for x in parts], np.int64)
            found = np.concatenate(parts)
        return found, counts


def _listed(pieces: pa.Array) -> list[str]:
    """Pieces without white space as a list, made in one go."""
    if not len(pieces):
        return []
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(pieces)], pa.int32()), pieces.cast(pa.string())), " ")[0].as_py().split(" ")


def _parts(piece: str, split) -> list[str]:
    """The words of a piece; letters, and letters before a mark, need no pattern."""
    if piece.isalpha() or not piece:
        return [piece]
    return [piece[:-1], piece[-1]] if piece[-1] in MARKS and piece[:-1].isalpha() else split(piece)


@cache
def library(path: str) -> LibraryBpe:
    return LibraryBpe(path)


def id_bytes(vocabulary: str) -> int:
    """Bytes of an id while documents wait to be coded."""
    return 2 if max(library(vocabulary).strings) < 1 << 16 else 4


def encode(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """doc_id, n_ids and ids (little-endian, as wide as id_bytes says, with the end id) of each row of docs (doc_id, text)."""
    path = vocabulary or default_vocabulary()
    kind = f"<u{id_bytes(path)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = library(path)
        for batch in batches:
            _, offsets = utf8(batch.column(1))
            for at, to in slices(offsets, SLICE):
                ids, n = model.encode_all([t or "" for t in batch.column(1).slice(at, to - at).to_pylist()])
                out = np.full(len(ids) + len(n), end_id, kind)
                out[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
                ends = (out.itemsize * np.append(0, np.cumsum(n + 1))).astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(out)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(n + 1, pa.int64()), packed], ["doc_id", "n_ids", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_ids bigint, ids binary")


def counts(encoded: DataFrame) -> DataFrame:
    """id, n: how often each id stands in all rows of encode; each task counts its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                n, raw = batch.column(0).slice(at, 500).to_pylist(), b"".join(batch.column(1).slice(at, 500).to_pylist())
                found = np.bincount(np.frombuffer(raw, f"<u{len(raw) // sum(n)}"))
                if len(found) > len(total):
                    total, found = found.astype(np.int64), total
                total[: len(found)] += found
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(total[there], pa.int64())], ["id", "n"])

    return encoded.select("n_ids", "ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def code_lengths(n: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Bits of each symbol's code word by its count: least in sum of all with none above limit (package-merge)."""
    if len(n) > 1 << limit:
        raise ValueError(f"{len(n)} symbols need more than {limit} bits")
    if len(n) < 2:
        return np.ones(len(n), np.int64)
    order = np.argsort(n, kind="stable")
    leaves = n[order].astype(np.int64)
    levels, packages = [], np.zeros(0, np.int64)
    for _ in range(limit):
        items = np.concatenate([leaves, packages])
        by = np.argsort(items, kind="stable")
        levels.append(by < len(leaves))
        items = items[by]
        packages = items[: len(items) // 2 * 2].reshape(-1, 2).sum(axis=1)
    lengths, taken = np.zeros(len(n), np.int64), 2 * len(n) - 2
    for is_leaf in reversed(levels):
        found = int(is_leaf[:taken].sum())
        lengths[:found] += 1
        taken = 2 * (taken - found)
    out = np.empty(len(n), np.int64)
    out[order] = lengths
    return out


class Code:
    """A canonical code: shorter words first, of equal lengths in the order of ids. Ids and lengths say it all."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, limit: int = LIMIT):
        self.limit = limit
        order = np.lexsort((ids, lengths))
        ids, lengths = ids[order].astype(np.int64), lengths[order].astype(np.int64)
        room = np.left_shift(1, limit - lengths)
        starts = np.cumsum(room) - room  # of each word in the table of all `limit`-bit numbers
        top = int(ids.max(initial=0)) + 1
        self.words, self.lengths = np.zeros(top, np.uint64), np.zeros(top, np.int64)
        self.words[ids], self.lengths[ids] = (starts >> (limit - lengths)).astype(np.uint64), lengths
        self.symbol, self.width = np.zeros(1 << limit, np.uint32), np.ones(1 << limit, np.uint8)
        self.symbol[: int(room.sum())] = np.repeat(ids, room)
        self.width[: int(room.sum())] = np.repeat(lengths, room)

    def encode(self, ids: np.ndarray, sizes: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces of ids (their sizes, none 0) in code words, first bit first, each from a byte on: bytes, bytes of each piece, bits of each stride."""
        width = self.lengths[ids]
        ends = np.cumsum(width)
        last = np.cumsum(sizes)
        bits = np.diff(ends[last - 1], prepend=0)
        n_bytes = -(-bits // 8)
        starts = ends - width + np.repeat(8 * (np.cumsum(n_bytes) - n_bytes) - (ends[last - 1] - bits), sizes)
        marks = np.add.reduceat(width, np.flatnonzero((np.arange(len(ids)) - np.repeat(last - sizes, sizes)) % stride == 0))
        word, taken = starts >> 6, (starts & 63) + width  # the 64-bit word where a code word begins, and its bits that are taken then
        codes, over = self.words[ids], np.maximum(taken - 64, 0)
        high = np.where(over > 0, codes >> over.astype(np.uint64), codes << np.where(over > 0, 0, 64 - taken).astype(np.uint64))
        total = int(n_bytes.sum())
        packed = np.zeros(total // 8 + 2, np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        packed[word[first]] = np.bitwise_or.reduceat(high, first)
        spills = np.flatnonzero(over)
        packed[word[spills] + 1] |= codes[spills] << (64 - over[spills]).astype(np.uint64)
        return np.frombuffer(packed.astype(">u8").tobytes(), np.uint8)[:total], n_bytes, marks

    def decode(self, code: np.ndarray, marks: np.ndarray, sizes: np.ndarray, stride: int = STRIDE) -> list[np.ndarray]:
        """Ids of the pieces that encode has made, from all checkpoints at once."""
        runs = -(-sizes // stride)
        first = np.cumsum(runs) - runs
        n_bytes = -(-np.add.reduceat(marks, first) // 8)
        ends = np.cumsum(marks)
        before = np.repeat(ends[first] - marks[first], runs)  # bits of the pieces before
        at = ends - marks - before + np.repeat(8 * (np.cumsum(n_bytes) - n_bytes), runs)
        data = np.concatenate([code, np.zeros(8, np.uint8)]).astype(np.uint32)
        windows = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
        out = np.empty((len(at), stride), np.uint32)
        mask, end = np.uint32((1 << self.limit) - 1), len(windows) - 1
        for k in range(stride):  # a short last run reads on into what follows, which is cut off below
            peek = windows[np.minimum(at >> 3, end)] >> (32 - self.limit - (at & 7)).astype(np.uint32) & mask
            out[:, k] = self.symbol[peek]
            at = at + self.width[peek]
        return [out[f : f + r].ravel()[:n] for f, r, n in zip(first.tolist(), runs.tolist(), sizes.tolist(), strict=True)]


def pieces_of(sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the pieces of documents (their sizes), and the document of each."""
    n = [-(-s // PIECE_IDS) for s in sizes]
    owner = np.repeat(np.arange(len(sizes)), n)
    out = np.full(len(owner), PIECE_IDS, np.int64)
    last = np.cumsum(n) - 1
    out[last] = np.array(sizes, np.int64) - PIECE_IDS * (np.array(n) - 1)
    return out, owner


def together(sizes: np.ndarray) -> Iterator[slice]:
    """Pieces in groups of at most TOGETHER ids."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOGETHER, "right")))
        yield slice(at, to)
        at = to


def mark_kind(limit: int, stride: int) -> str:
    return "<u4" if stride * limit >= 1 << 16 else "<u2"


def coded(docs: list[np.ndarray], code: Code, stride: int = STRIDE) -> list[tuple[bytes, bytes]]:
    """Code words and checkpoints of each document (its ids)."""
    sizes, owner = pieces_of([len(d) for d in docs])
    ids, ends = np.concatenate(docs), np.cumsum(sizes)
    words, marks = [[] for _ in docs], [[] for _ in docs]
    kind = mark_kind(code.limit, stride)
    for group in together(sizes):
        some = sizes[group]
        data, n_bytes, bits = code.encode(ids[ends[group.start] - sizes[group.start] : ends[group.stop - 1]], some, stride)
        runs = np.cumsum(-(-some // stride))
        to = np.cumsum(n_bytes)
        bits = bits.astype(kind)
        for k, d in enumerate(owner[group].tolist()):
            words[d].append(data[to[k] - n_bytes[k] : to[k]].tobytes())
            marks[d].append(bits[runs[k - 1] if k else 0 : runs[k]].tobytes())
    return [(b"".join(w), b"".join(m)) for w, m in zip(words, marks, strict=True)]


def pack_block(docs: list[tuple[str, int, bytes, bytes]], start: int, n_marks: int) -> bytes:
    """A block of documents (doc_id as JSON, ids, code words, checkpoints); start is the place of its first id in its part."""
    names = json.dumps([d[0] for d in docs], separators=(",", ":")).encode()
    words = b"".join(d[2] for d in docs)
    head = HEADER.pack(MAGIC, sum(d[1] for d in docs), len(docs), n_marks, len(words), start)
    sizes = np.array([d[1] for d in docs], "<u4").tobytes()
    body = b"".join([head, struct.pack("<I", len(names)), names, sizes, *(d[3] for d in docs), words])
    return body + struct.pack("<I", zlib.crc32(body))


def unpack_block(raw: bytes, code: Code, stride: int = STRIDE) -> tuple[int, list[str], list[int], list[bytes]]:
    """start, doc_ids (JSON), number of ids and ids (little-endian 32-bit) of a block's documents; ValueError if it is damaged."""
    if raw[:8] != MAGIC or zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
        raise ValueError("a block of token ids is damaged")
    _, _, n_docs, n_marks, n_words, start = HEADER.unpack_from(raw)
    at = HEADER.size
    (n_names,) = struct.unpack_from("<I", raw, at)
    names = json.loads(raw[at + 4 : at + 4 + n_names])
    at += 4 + n_names
    doc_sizes = np.frombuffer(raw, "<u4", n_docs, at).tolist()
    at += 4 * n_docs
    kind = np.dtype(mark_kind(code.limit, stride))
    marks = np.frombuffer(raw, kind, n_marks, at).astype(np.int64)
    words = np.frombuffer(raw, np.uint8, n_words, at + kind.itemsize * n_marks)
    sizes, owner = pieces_of(doc_sizes)
    runs = np.cumsum(-(-sizes // stride))
    ids: list[list[bytes]] = [[] for _ in doc_sizes]
    byte = 0
    for group in together(sizes):
        some = marks[runs[group.start - 1] if group.start else 0 : runs[group.stop - 1]]
        per = -(-sizes[group] // stride)
        to = byte + int((-(-np.add.reduceat(some, np.cumsum(per) - per) // 8)).sum())
        for d, found in zip(owner[group].tolist(), code.decode(words[byte:to], some, sizes[group], stride), strict=True):
            ids[d].append(found.astype("<u4").tobytes())
        byte = to
    return start, names, doc_sizes, [b"".join(i) for i in ids]


def write(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID, block_ids: int = BLOCK_IDS, limit: int = LIMIT, stride: int = STRIDE) -> None:
    """Writes the ids of docs (doc_id, text) under path, documents in the order of doc_id (null first).

    path/code has the length of each id's code word, path/blocks the blocks (part, block, n_docs, n_ids, data), and path/format the
    limit and stride. Parts are ranges of doc_id, in order; rows that share a doc_id are in the order of a hash of their code. A null or empty
    text has the end id alone; an empty table gives no block. Columns besides the two are let be.
    """
    if not 1 <= limit <= 25:
        raise ValueError("limit must be between 1 and 25 bits")
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        encoded = scratch.stored(encode(docs, vocabulary, end_id), compression="zstd")
        found = counts(encoded).toArrow()  # at most one row for each id of the vocabulary
        ids, lengths = found["id"].to_numpy(), code_lengths(found["n"].to_numpy(), limit)
        spark.createDataFrame([(int(i), int(b)) for i, b in zip(ids, lengths, strict=True)], "id bigint, bits int").coalesce(1).write.parquet(f"{path}/code")
        spark.createDataFrame([(limit, stride)], "code_limit int, stride int").coalesce(1).write.parquet(f"{path}/format")
        shared = spark.sparkContext.broadcast((ids, lengths))

        def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            code = Code(*shared.value, limit)
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    n = part.column(1).to_pylist()
                    docs = [np.frombuffer(raw, f"<u{len(raw) // k}") for raw, k in zip(part.column(2).to_pylist(), n, strict=True)]
                    words, marks = zip(*coded(docs, code, stride), strict=True)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(words, pa.binary()), pa.array(marks, pa.binary())], ["doc_id", "n_ids", "words", "marks"])

        kind = docs.schema["doc_id"].dataType.simpleString()
        short = encoded.mapInArrow(shorten, f"doc_id {kind}, n_ids bigint, words binary, marks binary")
        short = scratch.stored(short.select("*", F.xxhash64("words").alias("tie"), F.monotonically_increasing_id().alias("row")))
        scratch.spent(0, 1)
        mark_bytes = int(mark_kind(limit, stride)[-1])

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, block, start, size, n_marks = TaskContext.get().partitionId(), 0, 0, 0, 0
            held: list[tuple[str, int, bytes, bytes]] = []
            schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("n_docs", pa.int32()), ("n_ids", pa.int64()), ("data", pa.binary())])

            def row() -> pa.RecordBatch:
                return pa.RecordBatch.from_pylist([{"part": part, "block": block, "n_docs": len(held), "n_ids": size, "data": pack_block(held, start, n_marks)}], schema=schema)

            for batch in batches:
                for doc in zip(*(batch.column(i) for i in range(4)), strict=True):
                    doc_id, n, words, marks = (x.as_py() for x in doc)
                    if held and size + n > block_ids:
                        yield row()
                        block, start, size, n_marks, held = block + 1, start + size, 0, 0, []
                    held.append((doc_id, n, words, marks))
                    size, n_marks = size + n, n_marks + len(marks) // mark_bytes
            if held:
                yield row()

        tasks = max(1, -(-(short.agg(F.sum(F.octet_length("words"))).first()[0] or 0) // TASK_BYTES))
        order = ["doc_id", "tie", "row"]  # equal rows are parted by their number
        ranged = short.repartitionByRange(int(tasks), *order).sortWithinPartitions(*order)
        named = ranged.select(F.to_json(F.struct("doc_id")).alias("doc_id"), "n_ids", "words", "marks")
        named.mapInArrow(gather, "part int, block int, n_docs int, n_ids bigint, data binary").write.option("compression", "none").parquet(f"{path}/blocks")
        shared.destroy()


def read(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (little-endian 32-bit) of each document of the files under path."""
    form = spark.read.parquet(f"{path}/format").first()
    limit, stride = form.code_limit, form.stride
    words = spark.read.parquet(f"{path}/code").toArrow()  # at most one row for each id of the vocabulary
    shared = spark.sparkContext.broadcast((words["id"].to_numpy(), words["bits"].to_numpy()))
    blocks = spark.read.parquet(f"{path}/blocks")
    sizes = sorted((r.part, r.n) for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())  # one row for each file
    bases, before = [], 0
    for part, n in sizes:
        bases.append((part, before))
        before += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(*shared.value, limit)
        for batch in batches:
            for part, data in zip(batch.column(0), batch.column(1), strict=True):
                start, names, sizes, ids = unpack_block(data.as_py(), code, stride)
                ends = np.cumsum(sizes, dtype=np.int64)
                columns = [pa.array(np.full(len(names), part.as_py(), np.int32)), pa.array(names, pa.string()), pa.array(start + ends - np.array(sizes, np.int64)), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["part", "name", "start", "n_tokens", "ids"])

    rows = blocks.select("part", "data").mapInArrow(run, "part int, name string, start bigint, n_tokens bigint, ids binary")
    base = spark.createDataFrame(bases, "part int, before bigint")
    doc_id = F.from_json("name", f"doc_id {id_type}")["doc_id"].alias("doc_id")
    return rows.join(sized(base, len(bases)), "part").select(doc_id, (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids")


def op12_token_files(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = on_exit(spark, shared_dir(spark))
    write(docs, path)
    rows = read(spark, path, docs.schema["doc_id"].dataType.simpleString())
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
