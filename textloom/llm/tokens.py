"""Byte-level BPE encoding of whole corpora with a public vocabulary.

The JVM splits texts with the vocabulary's pattern; Python receives word lists, reduces each chunk to its distinct words
and merges them all at once. A pair occurrence index maps every adjacent pair to its positions in the chunk. Active
ranks are taken in ascending order, all positions of one rank are merged together, and the lists of the pairs this
touches are updated. Ascending order is enough: a pair with a merged token always has a higher rank than the merge.

Defined cases: a null, empty text gives an empty list; strings that look like special tokens are ordinary text; blanks
are tokens like others; equal texts get equal ids; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabularies; a parameter everywhere, never copied.
TOKENIZERS = os.environ.get("TEXTLOOM_TOKENIZERS", "/opt/tokenizers")
#: The vocabulary's split pattern, in Java syntax with Unicode classes.
SPLIT = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?[\p{Nd}\p{Nl}\p{No}]+| ?[^\s\p{L}\p{Nd}\p{Nl}\p{No}]+|\s+(?!\S)|\s+"
#: Bytes of distinct words merged at once; bounds a task's memory, not its input.
CHUNK_BYTES = 3_000_000


class Merges:
    """Ranks of one vocabulary file as arrays: id of each byte, and result id by pair of ids (ids are ranks)."""

    def __init__(self, path: str) -> None:
        tokens: dict[bytes, int] = {}
        with open(path, "rb") as f:
            for line in f:
                a, _, b = line.partition(b" ")
                if b.strip():
                    tokens[base64.b64decode(a)] = int(b)
        self.size = max(tokens.values()) + 1
        self.byte_id = np.array([tokens[bytes([i])] for i in range(256)], dtype=np.int32)
        keys, ids = [], []
        for token, rank in tokens.items():
            if len(token) > 1:
                parts = _parts(token, rank, tokens)
                if parts is not None:
                    keys.append(parts[0] << 32 | parts[1])
                    ids.append(rank)
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.keys = np.array(keys, dtype=np.int64)[order]
        self.ids = np.array(ids, dtype=np.int32)[order]
        self.left = np.zeros(self.size, dtype=np.int32)
        self.right = np.zeros(self.size, dtype=np.int32)
        self.left[self.ids] = (self.keys >> 32).astype(np.int32)
        self.right[self.ids] = (self.keys & 0xFFFFFFFF).astype(np.int32)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where the vocabulary doesn't join it."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ids[at], np.int32(-1))


def _parts(token: bytes, rank: int, tokens: dict[bytes, int]) -> tuple[int, int] | None:
    """The two ids whose merge gives the token: what stays when only lower ranks may merge."""
    own = [bytes([c]) for c in token]
    while len(own) > 2:
        best = min(((tokens.get(own[i] + own[i + 1], rank), i) for i in range(len(own) - 1)), default=(rank, 0))
        if best[0] >= rank:
            return None
        i = best[1]
        own[i : i + 2] = [own[i] + own[i + 1]]
    return tokens[own[0]], tokens[own[1]]


@lru_cache(maxsize=4)
def merges(path: str) -> Merges:
    """The vocabulary, read once per worker."""
    return Merges(path)


def merge_words(data: np.ndarray, starts: np.ndarray, m: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words laid end to end in ``data`` (bytes), and each word's number of ids.

    ``starts``: where each word begins, with the end of the last one behind; no word is empty.
    """
    n = len(data)
    sym = m.byte_id[data]
    nxt = np.arange(1, n + 1, dtype=np.int32)
    nxt[starts[1:] - 1] = -1
    prv = np.arange(-1, n - 1, dtype=np.int32)
    prv[starts[:-1]] = -1
    index: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def enter(pos: np.ndarray) -> None:
        """Enter pairs beginning at these positions into the index."""
        r = m.rank(sym[pos], sym[nxt[pos]])
        hit = r >= 0
        pos, r = pos[hit], r[hit]
        if not len(pos):
            return
        if len(pos) == 1:
            groups = ((int(r[0]), pos),)
        else:
            order = np.argsort(r, kind="stable")
            pos, r = pos[order], r[order]
            cut = np.flatnonzero(r[1:] != r[:-1]) + 1
            ranks = r[np.concatenate(([0], cut))].tolist()
            ends = [*cut.tolist(), len(pos)]
            groups, a = [], 0
            for rank, b in zip(ranks, ends):
                groups.append((rank, pos[a:b]))
                a = b
        for rank, part in groups:
            known = index.get(rank)
            if known is None:
                index[rank] = [part]
                heapq.heappush(active, rank)
            else:
                known.append(part)

    enter(np.flatnonzero(nxt >= 0).astype(np.int32))
    while active:
        rank = heapq.heappop(active)
        lists = index.pop(rank)
        pos = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        a, b = m.left[rank], m.right[rank]
        pos = pos[sym[pos] == a]
        to = nxt[pos]
        ok = to >= 0
        ok &= sym[to] == b
        pos, to = pos[ok], to[ok]
        if not len(pos):
            continue
        if a == b and len(pos) > 1:  # in a run of the same id every other pair merges
            new_run = np.ones(len(pos), dtype=bool)
            new_run[1:] = pos[1:] != to[:-1]
            run = np.cumsum(new_run) - 1
            first = np.flatnonzero(new_run)
            keep = (np.arange(len(pos)) - first[run]) % 2 == 0
            pos, to = pos[keep], to[keep]
        after = nxt[to]
        sym[pos] = rank
        sym[to] = -1
        nxt[pos] = after
        inner = after >= 0
        prv[after[inner]] = pos[inner]
        before = prv[pos]
        enter(np.unique(np.concatenate((before[before >= 0], pos[inner]))))
    alive = sym >= 0
    counts = np.add.reduceat(alive.astype(np.int64), starts[:-1]) if len(starts) > 1 else np.zeros(0, np.int64)
    return sym[alive], counts


def encode_lists(words: pa.ListArray, m: Merges, only_counts: bool = False) -> pa.Array:
    """Ids (or numbers of ids) of texts given as lists of words."""
    flat = words.flatten().dictionary_encode()
    sizes = np.diff(words.offsets.to_numpy())
    dic = flat.dictionary.cast(pa.large_binary())
    codes = flat.indices.to_numpy(zero_copy_only=False)
    if len(dic):
        offs = np.frombuffer(dic.buffers()[1], dtype=np.int64)[dic.offset : dic.offset + len(dic) + 1]
        raw = np.frombuffer(dic.buffers()[2], dtype=np.uint8)
        ids_parts, count_parts, a = [], [], 0
        while a < len(dic):  # by chunks of about CHUNK_BYTES
            b = max(a + 1, int(np.searchsorted(offs, offs[a] + CHUNK_BYTES, side="right")) - 1)
            b = min(b, len(dic))
            ids, counts = merge_words(raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a], m)
            ids_parts.append(ids)
            count_parts.append(counts)
            a = b
        ids, counts = np.concatenate(ids_parts), np.concatenate(count_parts)
    else:
        ids, counts = np.zeros(0, np.int32), np.zeros(0, np.int64)
    each = counts[codes]
    before = np.concatenate(([0], np.cumsum(each)))
    ends = before[np.concatenate(([0], np.cumsum(sizes)))]
    if only_counts:
        return pa.array(np.diff(ends), pa.int64())
    at = np.concatenate(([0], np.cumsum(counts)))[:-1]
    take = np.arange(before[-1]) - np.repeat(before[:-1] - at[codes], each)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids[take], pa.int32()))


def split_words(text: Column) -> Column:
    """A text's words by the vocabulary's pattern; null counts as empty."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SPLIT), F.lit(0))


def encode(df: DataFrame, key: str, text: str, tokenizers: str = TOKENIZERS, vocabulary: str = "byte_bpe_50k", only_counts: bool = False) -> DataFrame:
    """``key`` and ``ids`` (array<int>), or ``n_tokens`` (bigint), of every row; no shuffle."""
    path = f"{tokenizers}/{vocabulary}.tiktoken"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merges(path)
        for batch in batches:
            for part in _slices(batch):
                got = encode_lists(part.column(1), m, only_counts)
                yield pa.RecordBatch.from_arrays([part.column(0), got], names=[key, "n_tokens" if only_counts else "ids"])

    kind = df.schema[key].dataType.simpleString()
    made = "n_tokens bigint" if only_counts else "ids array<int>"
    return df.select(F.col(key), split_words(F.col(text)).alias("words")).mapInArrow(run, f"`{key}` {kind}, {made}")


def _slices(batch: pa.RecordBatch, words: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Row slices of about so many words; one row is never cut."""
    ends = batch.column(1).offsets.to_numpy()
    a = 0
    while a < batch.num_rows:
        b = int(np.searchsorted(ends, ends[a] + words, side="right")) - 1
        b = min(max(b, a + 1), batch.num_rows)
        part = batch.slice(a, b - a)
        yield part
        a = b
