"""Token ids of whole texts by a public byte-level BPE vocabulary.

Texts are cut by the vocabulary's pattern; the different pieces of a batch that
were not seen before are encoded together as padded matrices, one for each range
of lengths.  In each round every row merges its leftmost pair of least rank, found
in a hash table of pairs, and rows without a pair leave the matrix.  Pieces longer
than LONGEST bytes (text without any break) do the same merges from a heap.

Null and empty texts give an empty list.  Marker strings are ordinary text.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Fixed value: the pattern of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONGEST = 256
#: Different pieces that a task remembers before it starts anew, and encodes at once.
REMEMBERED = 400_000
_NONE = np.int32(2**31 - 1)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file: itself if it prints, else from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b) if b in plain else chr(spare))
        spare += b not in plain
    return out


class PairTable:
    """Open-addressing hash table from pairs of ids to (rank, merged id)."""

    def __init__(self, pairs: np.ndarray, merged: np.ndarray):
        keys = (pairs[:, 0].astype(np.int64) << 32) | pairs[:, 1]
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.mask, self.shift = (1 << bits) - 1, np.uint64(64 - bits)
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.rank = np.full(1 << bits, _NONE, dtype=np.int32)
        self.merged = np.concatenate([merged, np.zeros(1, merged.dtype)]).astype(np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot] == -1
            _, first = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            put = first[free[first]]
            self.keys[slot[put]] = keys[left[put]]
            self.rank[slot[put]] = left[put]
            rest = np.ones(len(left), bool)
            rest[put] = False
            left, slot = left[rest], (slot[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, _NONE where it is no pair; ids below 0 pad."""
        keys = (a.astype(np.int64) << 32) | b.astype(np.int64)
        out = np.full(keys.shape, _NONE, dtype=np.int32)
        todo = np.flatnonzero(((a >= 0) & (b >= 0)).ravel())
        flat, result = keys.ravel(), out.ravel()
        slot = self._slot(flat[todo])
        while len(todo):
            found = self.keys[slot]
            hit = found == flat[todo]
            result[todo[hit]] = self.rank[slot[hit]]
            on = ~hit & (found != -1)
            todo, slot = todo[on], (slot[on] + 1) & self.mask
        return out


class Encoder:
    def __init__(self, bytes_to_id: np.ndarray, pairs: np.ndarray, merged: np.ndarray):
        import regex

        self.table, self.bytes_to_id = PairTable(pairs, merged), bytes_to_id.astype(np.int32)
        self.split = regex.compile(PATTERN).findall
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.starts, self.ids, self.parts = np.zeros(1, np.int64), np.empty(0, np.int32), []

    def _matrix(self, rows: np.ndarray) -> list[np.ndarray]:
        """ids of each row of a padded matrix (-1)."""
        out: list[np.ndarray] = [rows[:0]] * len(rows)
        who = np.arange(len(rows))
        rank = self.table.ranks(rows[:, :-1], rows[:, 1:])
        while True:
            at = rank.argmin(1)
            best = rank[np.arange(len(rows)), at]
            done = best == _NONE
            if done.any():
                sizes = (rows[done] >= 0).sum(1)
                for k, ids, n in zip(who[done].tolist(), rows[done], sizes.tolist()):
                    out[k] = ids[:n]
                rows, rank, who, at, best = rows[~done], rank[~done], who[~done], at[~done], best[~done]
            if not len(rows):
                return out
            n = np.arange(len(rows))
            width = rows.shape[1]
            rows[n, at] = self.table.merged[best]
            take = np.arange(width) + (np.arange(width) > at[:, None])
            take[:, -1] = width - 1
            rows = np.take_along_axis(rows, take, 1)
            rows[:, -1] = -1
            take = np.arange(width - 1) + (np.arange(width - 1) > at[:, None])
            take[:, -1] = width - 2
            rank = np.take_along_axis(rank, take, 1)
            rank[:, -1] = _NONE
            right = np.minimum(at, width - 2)
            rank[n, right] = self.table.ranks(rows[n, right], rows[n, right + 1])
            left = at > 0
            rank[n[left], at[left] - 1] = self.table.ranks(rows[n[left], at[left] - 1], rows[n[left], at[left]])
            used = int((rows >= 0).sum(1).max())
            if 2 <= used <= width // 2:
                rows, rank = rows[:, :used], rank[:, : used - 1]

    def _long(self, ids: np.ndarray) -> np.ndarray:
        """The same merges for one long piece, from a heap of pairs, in n log n."""
        n = len(ids)
        value, after, before = ids.tolist(), [*range(1, n), -1], [-1, *range(n - 1)]
        merged, table = self.table.merged, {}

        def rank(a: int, b: int) -> int:
            if (a, b) not in table:
                table[a, b] = int(self.table.ranks(np.array([a]), np.array([b]))[0])
            return table[a, b]

        first = self.table.ranks(ids[:-1], ids[1:])
        heap = [(int(first[k]), k, value[k], value[k + 1]) for k in np.flatnonzero(first != _NONE).tolist()]
        heapq.heapify(heap)
        while heap:
            best, k, a, b = heapq.heappop(heap)
            right = after[k]
            if value[k] != a or right < 0 or value[right] != b:
                continue
            value[k], value[right] = int(merged[best]), -1
            after[k] = after[right]
            if after[right] >= 0:
                before[after[right]] = k
            for left, to in ((before[k], k), (k, after[k])):
                if left >= 0 and to >= 0:
                    r = rank(value[left], value[to])
                    if r != _NONE:
                        heapq.heappush(heap, (r, left, value[left], value[to]))
        return np.array([v for v in value if v >= 0], dtype=np.int32)

    def _learn(self, pieces: list[str]) -> None:
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = self.bytes_to_id[np.frombuffer(b"".join(raw), np.uint8)]
        starts = np.cumsum(sizes) - sizes
        found: list[np.ndarray] = [flat[:0]] * len(raw)
        bound = 1
        while bound < LONGEST:
            low, bound = bound, bound * 2
            pick = np.flatnonzero((sizes > low) & (sizes <= bound) if low > 1 else sizes <= bound)
            if not len(pick):
                continue
            rows = np.full((len(pick), bound), -1, dtype=np.int32)
            inside = np.arange(bound) < sizes[pick][:, None]
            rows[inside] = flat[np.repeat(starts[pick], sizes[pick]) + np.arange(inside.sum()) - np.repeat(np.cumsum(sizes[pick]) - sizes[pick], sizes[pick])]
            for k, ids in zip(pick.tolist(), self._matrix(rows)):
                found[k] = ids
        for k in np.flatnonzero(sizes > LONGEST).tolist():
            found[k] = self._long(flat[starts[k] : starts[k] + sizes[k]])
        base = len(self.known)
        self.known.update(zip(pieces, range(base, base + len(pieces))))
        self.ids = np.concatenate([self.ids, *found])
        self.starts = np.r_[self.starts, self.starts[-1] + np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of all texts."""
        words: list[str] = []
        counts = np.zeros(len(texts), dtype=np.int64)
        for k, text in enumerate(texts):
            if text:
                found = self.split(text)
                counts[k] = len(found)
                words += found
        if len(self.known) > REMEMBERED:
            self._forget()
        new = sorted(set(words).difference(self.known))
        if new:
            self._learn(new)
        index = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        sizes = self.starts[index + 1] - self.starts[index]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.arange(total) + np.repeat(self.starts[index] - (ends - sizes), sizes)] if total else self.ids[:0]
        offsets = np.r_[0, ends][np.r_[0, np.cumsum(counts)]] if len(ends) else np.zeros(len(texts) + 1, np.int64)
        return ids, offsets


def load(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of the 256 bytes, pairs, merged ids) of a byte-level BPE file in JSON form."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    pairs, merged = [], []
    for m in model["merges"]:
        a, b = m.split(" ") if isinstance(m, str) else m
        pairs.append((vocab[a], vocab[b]))
        merged.append(vocab[a + b])
    return np.array([vocab[c] for c in byte_letters()]), np.array(pairs, dtype=np.int64).reshape(-1, 2), np.array(merged)


def encode_texts(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", block: int = 1 << 23) -> DataFrame:
    """(key, ids ARRAY<INT>), one row for each row.

    ``vocabulary`` is the path of the vocabulary file on the driver; its pairs (a
    table of fixed size) travel with the tasks.  Texts are encoded about ``block``
    characters at a time.
    """
    tables = load(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*tables)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            lo, size = 0, 0
            for k in range(len(texts) + 1):
                if k == len(texts) or size > block:
                    if k > lo:
                        ids, offsets = encoder.encode(texts[lo:k])
                        lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                        yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, k - lo), lists], [key, "ids"])
                    lo, size = k, 0
                if k < len(texts):
                    size += len(texts[k] or "")

    schema = T.StructType([df.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return df.select(key, text).mapInArrow(run, schema)
