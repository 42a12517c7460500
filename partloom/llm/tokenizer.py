"""Problem 8: token ids of every text by a public byte-level BPE vocabulary.

Method: pair occurrence index. The distinct pre-tokens of a batch lie end to end as bytes; every pair that can merge
has the list of its positions; active ranks are applied in ascending order, each to all its positions at once, and the
lists of the pairs that a merge touches are updated.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.session import table

TOKENIZERS = "/opt/tokenizers"
# Fixed value: the pre-token pattern that belongs to the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Vocabulary:
    """Ranks of byte strings; a token's id is its rank."""

    def __init__(self, ranks_file: bytes):
        pairs = (line.split() for line in ranks_file.splitlines() if line.strip())
        self.rank = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.text = {r: t for t, r in self.rank.items()}
        self.byte_id = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        self.pattern = regex.compile(PATTERN)
        self.known: dict[str, np.ndarray] = {}
        self.pair: dict[tuple[int, int], int] = {}

    def merged(self, left: int, right: int) -> int:
        """Rank of the token that two neighbours make, or -1."""
        key = (left, right)
        found = self.pair.get(key)
        if found is None:
            found = self.pair[key] = self.rank.get(self.text[left] + self.text[right], -1)
        return found

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each pre-token, all merged together through one index of pair positions."""
        raw = [w.encode() for w in words]
        sizes = np.array([len(r) for r in raw], np.int64)
        start = np.cumsum(sizes) - sizes
        ids = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        n = len(ids)
        ends = np.zeros(n, bool)
        ends[start + sizes - 1] = True
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends] = -1
        before[start] = -1

        left = np.flatnonzero(~ends)
        codes, inverse = np.unique(ids[left] << 32 | ids[left + 1], return_inverse=True)
        order = np.argsort(inverse, kind="stable")
        positions: dict[int, list[int]] = {}
        for code, at in zip(codes.tolist(), np.split(left[order], np.cumsum(np.bincount(inverse, minlength=len(codes)))[:-1]) if len(codes) else [], strict=True):
            if (r := self.merged(code >> 32, code & 0xFFFFFFFF)) >= 0:
                positions.setdefault(r, []).extend(at.tolist())
        active = list(positions)
        heapq.heapify(active)
        sym, nxt, prv = ids.tolist(), after.tolist(), before.tolist()
        while active:
            rank = heapq.heappop(active)
            for i in sorted(positions.pop(rank, ())):
                j = nxt[i]
                if sym[i] < 0 or j < 0 or self.merged(sym[i], sym[j]) != rank:
                    continue  # a neighbour was merged away
                sym[i], sym[j] = rank, -1
                k, p = nxt[j], prv[i]
                nxt[i] = k
                if k >= 0:
                    prv[k] = i
                for a, b in ((i, k), (p, i)):
                    if a >= 0 and b >= 0 and (r := self.merged(sym[a], sym[b])) >= 0:
                        if r not in positions:
                            positions[r] = []
                            heapq.heappush(active, r)
                        positions[r].append(a)
        out = np.array(sym, np.int64)
        keep = out >= 0
        count = np.add.reduceat(keep, start) if n else np.zeros(0, np.int64)
        return np.split(out[keep].astype(np.int32), np.cumsum(count)[:-1]) if n else []

    def encode_batch(self, texts: list[str | None], most_known: int = 400_000) -> list[np.ndarray]:
        """Ids of whole texts; null and empty texts have none. Pre-tokens seen before are looked up."""
        if len(self.known) > most_known:
            self.known.clear()
        words = [self.pattern.findall(t) if t else [] for t in texts]
        new = list({w for ws in words for w in ws if w not in self.known})
        if new:
            self.known.update(zip(new, self.encode_words(new), strict=True))
        none = np.zeros(0, np.int32)
        return [np.concatenate([self.known[w] for w in ws]) if ws else none for ws in words]


@functools.lru_cache(maxsize=2)
def _vocabulary(ranks_file: bytes) -> Vocabulary:
    return Vocabulary(ranks_file)


def _ranks(spark, tokenizer: str, folder: str):
    """The vocabulary file (about a megabyte) as a broadcast, so executors need no copy of it."""
    return spark.sparkContext.broadcast(Path(folder, f"{tokenizer}.tiktoken").read_bytes())


def _batches(b: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for i in range(0, b.num_rows, rows):
        yield b.slice(i, rows)


def token_ids(documents: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``(key, ids)`` of every row: the ids of the whole text without special tokens.

    Null and empty texts have an empty list, never null; strings of special tokens are ordinary text; repeated rows and
    null keys are kept as they are; other columns are ignored.
    """
    ranks = _ranks(documents.sparkSession, tokenizer, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(ranks.value)
        for whole in batches:
            for b in _batches(whole):
                ids = vocabulary.encode_batch(b.column(text).to_pylist())
                off = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                yield pa.record_batch({key: b.column(key), "ids": pa.ListArray.from_arrays(pa.array(off), pa.array(flat))})

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, F.col(text).cast("string").alias(text)).mapInArrow(run, f"{key} {kind}, ids array<int>")


def token_counts(documents: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``(key, n_tokens)`` of every row; null and empty texts have 0."""
    ranks = _ranks(documents.sparkSession, tokenizer, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(ranks.value)
        for whole in batches:
            for b in _batches(whole):
                counts = [len(x) for x in vocabulary.encode_batch(b.column(text).to_pylist())]
                yield pa.record_batch({key: b.column(key), "n_tokens": pa.array(counts, pa.int64())})

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, F.col(text).cast("string").alias(text)).mapInArrow(run, f"{key} {kind}, n_tokens long")


def p8_ids(spark, sf_dir: str) -> DataFrame:
    return token_ids(table(spark, sf_dir, "documents"))


def p8_counts(spark, sf_dir: str) -> DataFrame:
    """Tokens and rows per language tag and source."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "source").join(token_counts(docs), "doc_id").groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
