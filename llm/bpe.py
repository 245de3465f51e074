"""Byte-level BPE with word ends: encoding and decoding of whole texts.

Method: a contiguous rank array. For a word, one array holds the part
boundaries and one the rank of each adjacent pair; the minimum is looked for by
scanning, its boundary deleted and the ranks of its two neighbours refreshed.
Long words, where scanning would be quadratic, keep the same ranks in a heap.

Null texts are empty texts, which have no tokens. Strings of special tokens in
a text are those tokens. Results depend on each row alone, so ties, repeated
rows, empty tables and further columns do not matter.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from llm.common import batches, ship, table

#: Unicode white space, as the normaliser collapses it.
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_PARTS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WHITE}\p{{L}}\p{{N}}]+")
_SPACE = regex.compile(f"[{WHITE}]+")
_ODD = regex.compile("[\x1c-\x1f]")
SCAN_MOST = 64
#: Chunks that a Python worker keeps the ids of.
CACHE_MOST = 200_000
#: Ids lie below; a pair's rank and merged id share an integer.
BITS = 1 << 16
NONE = 1 << 62


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = {}, 0
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return [out[b] for b in range(256)]


class Bpe:
    """The model of one vocabulary file; holds a bounded cache of chunks."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.tokens = {i: t.encode() for t, i in (self.ids | self.special).items()}
        if len(self.ids) + len(spec.get("added_tokens", [])) > BITS:
            raise ValueError(f"more than {BITS} ids")
        self.ranks: dict[int, int] = {}  # both ids of a pair -> its rank and the merged id
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[self.ids[a] * BITS + self.ids[b]] = rank * BITS + self.ids[a + b]
        chars = byte_chars()
        self.inner = [self.ids[c] for c in chars]
        self.last = [self.ids[c + self.suffix] for c in chars]
        self._split = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.cache: dict[str, bytes] = {}

    def word(self, word: bytes) -> list[int]:
        """Ids of one pre-token."""
        parts = [self.inner[b] for b in word[:-1]] + [self.last[word[-1]]]
        return self._scan(parts) if len(parts) <= SCAN_MOST else self._heap(parts)

    def _scan(self, parts: list[int]) -> list[int]:
        get = self.ranks.get
        ranks = [get(a * BITS + b, NONE) for a, b in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == NONE:
                break
            i = ranks.index(best)
            parts[i] = merged = best % BITS
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] * BITS + merged, NONE)
            if i < len(ranks):
                ranks[i] = get(merged * BITS + parts[i + 1], NONE)
        return parts

    def _heap(self, parts: list[int]) -> list[int]:
        n = len(parts)
        after, before, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        get = self.ranks.get
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := get(parts[i] * BITS + parts[i + 1], NONE)) != NONE]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j], after[i] = r % BITS, False, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (r := get(parts[k] * BITS + parts[after[k]], NONE)) != NONE:
                    heapq.heappush(heap, (r, k, parts[k], parts[after[k]]))
        return [p for p, live in zip(parts, alive) if live]

    def normalize(self, chunk: str) -> str:
        # character by character, as the library lowers; a capital sigma has no final form then
        return unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()

    def chunk_ids(self, chunk: str) -> list[int]:
        """Ids of a text without white space."""
        return [i for part in _PARTS.findall(self.normalize(chunk)) for i in self.word(part.encode())]

    def _chunk(self, chunk: str) -> bytes:
        ids = self.chunk_ids(chunk)
        out = struct.pack(f"<{len(ids)}H", *ids)
        if len(self.cache) < CACHE_MOST and len(chunk) <= 40:
            self.cache[chunk] = out
        return out

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text."""
        if not text:
            return np.zeros(0, dtype="<u4")
        get, chunk, out = self.cache.get, self._chunk, []
        for k, piece in enumerate(self._split.split(text) if self._split and "<|" in text else [text]):
            if k % 2:
                out.append(struct.pack("<H", self.special[piece]))
                continue
            for c in _SPACE.split(piece) if _ODD.search(piece) else piece.split():
                ids = get(c)
                out.append(chunk(c) if ids is None else ids)
        return np.frombuffer(b"".join(out), dtype="<u2").astype("<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the text: without a decoder in the file, tokens are joined by spaces."""
        return b" ".join(map(self.tokens.__getitem__, ids.tolist()))


_models: dict[str, Bpe] = {}


def _model(text: str) -> Bpe:
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _models:
        _models.clear()
        _models[key] = Bpe(text)
    return _models[key]


def encode_documents(spark: SparkSession, docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), with_ids: bool = False) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256, the columns in ``keep``, and ``ids`` (packed) if asked for.

    The vocabulary (a fixed file) is broadcast; rows are mapped where they are.
    """
    ship(spark)
    with open(path or default_path(), encoding="utf-8") as f:
        model = spark.sparkContext.broadcast(f.read())
    source = docs.select(id_col, text_col, *keep)
    names = list(dict.fromkeys([id_col, *keep]))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _model(model.value)
        for batch in batches(it, 500):
            n, ids, decoded, packed = [], [], [], []
            for text in batch.column(1):
                i = bpe.encode(text.as_py())
                n.append(len(i))
                ids.append(hashlib.sha256(i).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(i)).hexdigest())
                if with_ids:
                    packed.append(i.tobytes())
            cols = [batch.column(batch.schema.names.index(c)) for c in names]
            cols += [pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(packed, pa.binary())] if with_ids else []), names + ["n_tokens", "ids_sha256", "decoded_sha256"] + (["ids"] if with_ids else []))

    schema = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in names)
    return source.mapInArrow(run, f"{schema}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary" if with_ids else ""))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(spark, table(spark, sf_dir, "documents", "doc_id", "text"))
