"""BPE encoding and decoding.

Encoding merges a word with a priority queue of merge ranks over a doubly linked list of symbols; entries whose
symbols have changed since they were queued are stale and skipped. Decoding concatenates vocabulary strings. Words
that were seen before come from a bounded memo in each worker. One map over the texts, no shuffle.

Defined results: a null text is encoded as the empty text, which has no ids; special strings of the file inside a
text become their ids; texts of any length are encoded whole; repeated rows each keep a row; columns beside the id
and the text are not read.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import pretokens
from .common import SLICE, prepare, text_or_empty

#: Most words in a worker's memo (about 80 MB); beyond it the oldest go, which changes no result.
MEMO = 400_000


class Encoder:
    def __init__(self, path: str, memo: int = MEMO):
        self.bpe = pretokens.load(path)
        self.memo, self.bare = pretokens.Memo(self.spaced, memo), pretokens.Memo(self.word, memo // 4)
        self.split_special = pretokens.special_pattern(tuple(self.bpe.special))

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token."""
        ids = [self.bpe.byte_ids[b] for b in word]
        n = len(ids)
        if n < 2:
            return ids
        ranks, merged = self.bpe.ranks, self.bpe.merged
        bits = max(12, n.bit_length())
        mask = (1 << bits) - 1
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        now = [ranks[a].get(b, -1) for a, b in zip(ids, ids[1:])]  # rank of the pair that begins at each place
        now.append(-1)
        queue = [r << bits | i for i, r in enumerate(now) if r >= 0]
        heapify(queue)
        while queue:
            top = heappop(queue)
            i, rank = top & mask, top >> bits
            if now[i] != rank:
                continue  # stale: a symbol of this pair has gone or grown
            j = after[i]
            ids[i] = new = merged[rank]
            ids[j] = now[j] = now[i] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks[new].get(ids[k], -1)) >= 0:
                    now[i] = r
                    heappush(queue, r << bits | i)
            if (k := before[i]) >= 0:
                now[k] = r = ranks[ids[k]].get(new, -1)
                if r >= 0:
                    heappush(queue, r << bits | k)
        return [i for i in ids if i >= 0]

    def word(self, word: str) -> bytes:
        return array("I", self.merge(word.encode())).tobytes()

    def spaced(self, piece: str) -> bytes:
        return self.unit(" " + piece)

    def unit(self, unit: str) -> bytes:
        """Ids of a unit of ``pretokens.units``, as little-endian unsigned 32-bit integers."""
        parts = self.split_special.split(unit) if self.split_special and "<" in unit else [unit]
        if len(parts) > 1:
            return b"".join(self.bpe.special[p].to_bytes(4, "little") if p in self.bpe.special else self.unit(p) for p in parts if p)
        words = pretokens.pattern().findall(unit)
        if len(words) == 1:
            return self.word(unit)
        return b"".join([self.memo[w[1:]] if w[0] == " " and len(w) > 1 else self.bare[w] for w in words])

    def encode(self, text: str) -> bytes:
        """Ids of a text, as little-endian unsigned 32-bit integers."""
        self.memo, self.bare = memo, _ = self.memo.renewed(), self.bare.renewed()
        pieces = text.split(" ")
        if pretokens.unclean().search(text):
            return b"".join([memo[unit[1:]] if unit[:1] == " " else self.unit(unit) for unit in pretokens.units(pieces)])
        return self.unit(pieces[0]) + b"".join(map(memo.__getitem__, pieces[1:]))

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bpe.token_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of each text."""
    prepare(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            for part in (batch.slice(k, SLICE) for k in range(0, batch.num_rows, SLICE)):
                ids = [np.frombuffer(coder.encode(x), "<i4") for x in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, ids)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids), pa.int32()))], [id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_or_empty(text_col).alias("text")).mapInArrow(work, f"{id_col} {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of each array of ids; null ids give the empty text."""
    prepare(encoded.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            for part in (batch.slice(k, SLICE) for k in range(0, batch.num_rows, SLICE)):
                texts = [coder.decode(np.array(x or [], "<u4").tobytes()) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, ids_col).mapInArrow(work, f"{id_col} {kind}, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes each text in one pass: (id, n_tokens, ids_sha256, decoded_sha256)."""
    prepare(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            for part in (batch.slice(k, SLICE) for k in range(0, batch.num_rows, SLICE)):
                n, of_ids, of_text = [], [], []
                for text in part.column(1).to_pylist():
                    ids = coder.encode(text)
                    n.append(len(ids) // 4)
                    of_ids.append(hashlib.sha256(ids).hexdigest())
                    of_text.append(hashlib.sha256(coder.decode(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_or_empty(text_col).alias("text")).mapInArrow(work, f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
