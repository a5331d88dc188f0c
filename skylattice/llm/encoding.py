"""Encoding of a whole corpus with a public byte-level tokenizer.

Texts are cut into pre-tokens by ``pretokens``; each different slice is merged once per worker and kept in a cache.
The vocabulary is the only thing sent to the executors (50,000 entries, about one megabyte whatever the corpus).
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from skylattice.llm.pretokens import slices

FOLDER = "/opt/tokenizers"


def read_ranks(name: str = "byte_bpe_50k", folder: str = FOLDER) -> dict[bytes, int]:
    """A rank file's vocabulary: the bytes of each token and its id."""
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PairMerger:
    """Merges the bytes of a slice by rank; results are cached."""

    def __init__(self, ranks: dict[bytes, int], keep: int = 400_000, longest: int = 600) -> None:
        self.ranks, self.keep, self.longest = ranks, keep, longest
        self.cache: dict[bytes, tuple[int, ...]] = {}

    def __call__(self, word: bytes) -> tuple[int, ...]:
        if (got := self.cache.get(word)) is not None:
            return got
        whole = self.ranks.get(word)
        out = (whole,) if whole is not None else self._few(word) if len(word) < 40 else self._many(word)
        if len(word) <= self.longest:
            if len(self.cache) >= self.keep:
                self.cache.clear()
            self.cache[word] = out
        return out

    def _few(self, word: bytes) -> tuple[int, ...]:
        ranks, parts = self.ranks, [word[i : i + 1] for i in range(len(word))]
        pairs = [ranks.get(parts[i] + parts[i + 1], 1 << 30) for i in range(len(parts) - 1)]
        while pairs and (low := min(pairs)) < 1 << 30:
            i = pairs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], 1 << 30)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 30)
        return tuple(ranks[p] for p in parts)

    def _many(self, word: bytes) -> tuple[int, ...]:
        """The same for long slices in n log n: a heap of pairs over a linked list."""
        ranks, n = self.ranks, len(word)
        part: list[bytes | None] = [word[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, part[i] + part[i + 1]) for i in range(n - 1) if (r := ranks.get(part[i] + part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if part[i] is None or j >= n or part[i] + part[j] != pair:
                continue
            part[i], part[j] = pair, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := ranks.get(pair + part[after[i]])) is not None:
                    heapq.heappush(heap, (r, i, pair + part[after[i]]))
            if (h := before[i]) >= 0 and (r := ranks.get(part[h] + pair)) is not None:
                heapq.heappush(heap, (r, h, part[h] + pair))
        return tuple(ranks[p] for p in part if p is not None)


_MERGERS: dict[tuple[str, str], PairMerger] = {}


def merger(name: str, folder: str, ranks: dict[bytes, int]) -> PairMerger:
    """The worker's own merger of a vocabulary, which keeps its cache from task to task."""
    if (name, folder) not in _MERGERS:
        _MERGERS[name, folder] = PairMerger(ranks)
    return _MERGERS[name, folder]


def encode_texts(texts: list[str], merge: PairMerger) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, ids per text, code-point offset of each slice, ids per slice, slices per text) of all texts in order."""
    data, start, stop, offset, per_text = slices(texts)
    found = [merge(data[a:b]) for a, b in zip(start.tolist(), stop.tolist())]
    ids = np.fromiter(chain.from_iterable(found), np.int32)
    per_slice = np.fromiter(map(len, found), np.int64, len(found))
    upto = np.r_[0, np.cumsum(per_slice)]
    last = np.cumsum(per_text)
    return ids, upto[last] - upto[last - per_text], offset, per_slice, per_text


def decode_ids(ids: list[int], ranks: dict[bytes, int]) -> str:
    """The text that was encoded."""
    token = {v: k for k, v in ranks.items()}
    return b"".join(token[i] for i in ids).decode("utf-8", "replace")


def portions(texts: list[str | None], most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` characters (one text may exceed it): what is held at once doesn't grow."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def spread(df: DataFrame) -> DataFrame:
    """Give every core work: rows are dealt out anew only where the scan has fewer parts than twice the cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(3 * cores) if df.rdd.getNumPartitions() < 2 * cores else df


def encode_corpus(documents: DataFrame, name: str = "byte_bpe_50k", folder: str = FOLDER, offsets: bool = False) -> DataFrame:
    """Token ids of each document's whole text: ``doc_id, ids``, without special tokens.

    Null, empty and blank texts are texts: null and empty give an empty list, blanks the ids of the blanks. Strings that
    look like special tokens are ordinary text. With ``offsets`` also ``starts``, the code-point offset of each
    pre-token, and ``counts``, its number of ids, so that any id can be traced to its place. Repeated rows give repeated
    results; other columns are ignored.
    """
    spark: SparkSession = documents.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(name, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge = merger(name, folder, ranks.value)
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in portions(texts):
                ids, per_text, offset, per_slice, slices_per_text = encode_texts([t or "" for t in texts[lo:hi]], merge)
                lists = lambda n, v: pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(v.astype(np.int32)))
                columns = [b.column(0).slice(lo, hi - lo), lists(per_text, ids)]
                names = ["doc_id", "ids"]
                if offsets:
                    columns += [lists(slices_per_text, offset), lists(slices_per_text, per_slice)]
                    names += ["starts", "counts"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    extra = ", starts array<int>, counts array<int>" if offsets else ""
    return spread(documents.select("doc_id", "text")).mapInArrow(run, "doc_id long, ids array<int>" + extra)
