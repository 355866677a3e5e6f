"""BPE encoding and decoding with a public word-end vocabulary file.

A word's symbols form a doubly linked list; a heap holds the rank and place of each adjacent
pair that merges, and entries whose symbols have changed meanwhile are skipped. Decoding joins
the vocabulary's strings. Texts never leave their partition; each worker loads the vocabulary
file once and remembers the ids of a bounded number of words.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.base import table

#: Words whose ids a worker remembers; when full, it starts anew. Longer words aren't remembered.
REMEMBERED, LONGEST = 400_000, 48


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself if printable in Latin-1, else the next letter from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


class Bpe:
    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in (vocab | self.specials).items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        letters = byte_letters()
        self.inner = [vocab.get(letters[b]) for b in range(256)]
        self.last = [vocab.get(letters[b] + self.suffix) for b in range(256)]
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}")).findall
        self.special_split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True)) + ")").split if self.specials else None
        self.known: dict[str, bytes] = {}

    def merge(self, symbols: list[int]) -> list[int]:
        """Applies the lowest-ranked merge, leftmost first, until none is left."""
        merges, n = self.merges, len(symbols)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(m[0], i, symbols[i], symbols[i + 1], m[1]) for i in range(n - 1) if (m := merges.get((symbols[i], symbols[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = right[i]
            if symbols[i] != a or j < 0 or symbols[j] != b:
                continue  # stale
            symbols[i], symbols[j] = made, -1
            k = right[i] = right[j]
            right[j] = -1
            if k >= 0:
                left[k] = i
                if m := merges.get((made, symbols[k])):
                    heapq.heappush(heap, (m[0], i, made, symbols[k], m[1]))
            h = left[i]
            if h >= 0 and (m := merges.get((symbols[h], made))):
                heapq.heappush(heap, (m[0], h, symbols[h], made, m[1]))
        return [s for s in symbols if s >= 0]

    def word(self, word: str) -> bytes:
        """A word's ids, packed."""
        raw = word.encode()
        symbols = [self.inner[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        ids = np.array(self.merge([s for s in symbols if s is not None]), "<u4").tobytes()
        if len(word) <= LONGEST:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if self.special_split is None or "<|" not in text and not any(s in text for s in self.specials):
            return self.ordinary(text)
        return b"".join(self.specials[p].to_bytes(4, "little") if p in self.specials else self.ordinary(p) for p in self.special_split(text))

    def ordinary(self, text: str) -> bytes:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # lower case letter by letter, without the rule for a word's last sigma
                text = text.replace("Σ", "σ")
        known, word = self.known, self.word
        return b"".join([known.get(w) or word(w) for w in self.split(text.lower())])

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@cache
def bpe(path: str) -> Bpe:
    return Bpe(path)


def encode_documents(docs: DataFrame, vocabulary: str | None = None, text: str = "text", decoded: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian 32-bit) and decoded text of each row.

    Null texts are empty and have no ids; rows and ids may repeat; an empty table gives an empty result.
    Special tokens written in a text are encoded as such. vocabulary must be readable at each executor.
    """
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # small outputs: ids and decoded texts are large
                part = batch.slice(at, 256)
                ids = [model.encode(t) if t else b"" for t in part.column(1).to_pylist()]
                out = [part.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())]
                if decoded:
                    out.append(pa.array([model.decode(i) for i in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_tokens", "ids", "decoded"][: len(out)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text).mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids binary" + ", decoded string" * decoded)


def decode_documents(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and the text of each row's ids (null: empty)."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(path)
        for batch in batches:
            texts = [model.decode(i or b"") for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "decoded"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, decoded string")


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    coded = encode_documents(table(spark, sf_dir, "documents"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
