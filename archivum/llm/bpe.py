"""Byte-level BPE encoding and decoding by corpus-level merge replay.

Each Arrow batch of texts is split by the pattern, its distinct pieces are
laid end to end as bytes, and an inverted index from the rank of a token pair
to the positions of that pair replays the merges in rank order over all
pieces at once. A merge touches only the positions listed for it and the two
neighbours of each. Pieces seen before come from a bounded memo.

Ranks are a fixed vocabulary (50 thousand entries, under 2 MB), so sending
them to every worker is bounded by the vocabulary and not by the data.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from archivum.llm._shared import for_python, release_memory

#: Pieces whose ids a worker remembers; beyond it the memo starts anew.
MEMO_PIECES = 200_000
#: More than the largest rank.
STEP = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, of a file with lines ``base64 rank``."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices of ``flat`` with these starts and lengths, end to end."""
    shift = starts - (np.cumsum(lengths) - lengths)
    return flat[np.repeat(shift, lengths) + np.arange(lengths.sum())]


class _Numbers(dict):
    """Numbers pieces as they come; ``fresh`` has those not yet encoded."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        self.fresh.append(piece)
        return number


class MergeReplay:
    """Ids of pieces under a rank table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        # Every pair of tokens that together are a token, by left * STEP + right.
        self.pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left * STEP + right] = rank
        self.keys = np.array(sorted(self.pairs), np.int64)
        self.values = np.array([self.pairs[k] for k in self.keys.tolist()], np.int64)
        self.forget()

    def forget(self) -> None:
        self.numbers = _Numbers()
        self.flat = np.zeros(0, np.int32)
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the tokens that pairs make, or -1."""
        keys = left * STEP + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], -1)

    def replay(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces (none empty) end to end, and how many each has.

        ``index`` maps a rank to the positions where a pair of that rank
        begins; ranks are replayed in order over all pieces at once. The
        positions of one rank are merged together unless two of them overlap
        or a merge makes a pair of lower rank; then they go one at a time.
        """
        data = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum([len(p) for p in pieces])
        size = len(data)
        symbol = self.byte_ids[data]
        after = np.arange(1, size + 1)
        after[ends - 1] = -1  # no pair crosses the end of a piece
        before = np.arange(-1, size - 1)
        before[ends[:-1]] = -1
        current = np.full(size, -1, np.int64)  # rank of the pair that starts here
        inner = np.flatnonzero(after >= 0)
        current[inner] = self.lookup(symbol[inner], symbol[inner + 1])
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def listed(places: np.ndarray, ranks: np.ndarray) -> None:
            known = ranks >= 0
            places, ranks = places[known], ranks[known]
            if len(places) == 0:
                return
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            firsts = [0, *cuts.tolist()]
            for start, stop, rank in zip(firsts, [*firsts[1:], len(places)], ranks[firsts].tolist()):
                if rank in index:
                    index[rank].append(places[start:stop])
                else:
                    index[rank] = [places[start:stop]]
                    heapq.heappush(queue, rank)

        listed(inner, current[inner])
        while queue:
            rank = heapq.heappop(queue)
            groups = index.pop(rank)
            places = np.sort(groups[0] if len(groups) == 1 else np.concatenate(groups))
            places = places[current[places] == rank]
            if len(groups) > 1 and len(places) > 1:
                places = places[np.concatenate(([True], places[1:] != places[:-1]))]
            if len(places) == 0:
                continue
            nxt = after[places]
            follow = after[nxt]
            if len(places) > 1 and (nxt[:-1] == places[1:]).any():
                self._singly(rank, places.tolist(), symbol, after, before, current, index, queue)
                continue
            has_next = follow >= 0
            at, beyond = places[has_next], follow[has_next]
            saved = symbol[places], symbol[nxt], current[nxt], before[beyond]
            symbol[places], symbol[nxt], current[nxt] = rank, -1, -1
            after[places] = follow
            before[beyond] = at
            right = np.full(len(places), -1, np.int64)
            right[has_next] = self.lookup(symbol[at], symbol[beyond])
            prior = before[places]
            has_prior = prior >= 0
            prior = prior[has_prior]
            left = self.lookup(symbol[prior], symbol[places[has_prior]])
            if ((right >= 0) & (right < rank)).any() or ((left >= 0) & (left < rank)).any():
                symbol[places], symbol[nxt], current[nxt], before[beyond] = saved
                after[places] = nxt
                self._singly(rank, places.tolist(), symbol, after, before, current, index, queue)
                continue
            current[places] = right
            current[prior] = left
            listed(places, right)
            listed(prior, left)
        kept = symbol >= 0
        counts = np.add.reduceat(kept, ends - np.diff(ends, prepend=0)) if size else np.zeros(0, np.int64)
        return symbol[kept].astype(np.int32), counts.astype(np.int64)

    def _singly(self, rank, places, symbol, after, before, current, index, queue) -> None:
        """Merge the positions of one rank in turn, leftmost first, and stop
        for any pair of lower rank that comes up."""

        def new_pair(at: int, left: int, right: int) -> bool:
            new = self.pairs.get(left * STEP + right, -1)
            current[at] = new
            if new >= 0:
                if new in index:
                    index[new].append(np.array([at]))
                else:
                    index[new] = [np.array([at])]
                    heapq.heappush(queue, new)
            return 0 <= new < rank

        for k, at in enumerate(places):
            if current[at] != rank:
                continue
            nxt = int(after[at])
            symbol[at], symbol[nxt], current[nxt], current[at] = rank, -1, -1, -1
            follow = after[at] = int(after[nxt])
            lower = False
            if follow >= 0:
                before[follow] = at
                lower = new_pair(at, rank, int(symbol[follow]))
            prior = int(before[at])
            if prior >= 0:
                lower = new_pair(prior, int(symbol[prior]), rank) or lower
            if lower and k + 1 < len(places):
                rest = np.array(places[k + 1 :])
                if rank in index:
                    index[rank].append(rest)
                else:
                    index[rank] = [rest]
                    heapq.heappush(queue, rank)
                return

    def learn(self) -> None:
        """Encode the pieces that were numbered since the last time."""
        fresh = [x.encode("utf-8", "replace") for x in self.numbers.fresh]
        self.numbers.fresh = []
        if not fresh:
            return
        whole = np.array([self.ranks.get(x, -1) for x in fresh], np.int64)
        split = np.flatnonzero(whole < 0)
        counts = np.ones(len(fresh), np.int64)
        ids = np.zeros(0, np.int32)
        if len(split):
            ids, counts[split] = self.replay([fresh[i] for i in split.tolist()])
        starts = np.cumsum(counts) - counts
        flat = np.zeros(counts.sum(), np.int32)
        flat[starts[whole >= 0]] = whole[whole >= 0]
        if len(split):
            flat[gather(np.arange(len(flat)), starts[split], counts[split])] = ids
        self.starts = np.concatenate((self.starts, starts + len(self.flat)))
        self.lengths = np.concatenate((self.lengths, counts))
        self.flat = np.concatenate((self.flat, flat))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the offsets of the texts."""
        if len(self.numbers) > MEMO_PIECES:
            self.forget()
        number, find = self.numbers.__getitem__, self.find
        pieces, counts = array("i"), []
        for text in texts:
            had = len(pieces)
            if text:
                pieces.extend(map(number, find(text)))
            counts.append(len(pieces) - had)
        self.learn()
        if not len(pieces):
            return np.zeros(0, np.int32), np.zeros(len(counts) + 1, np.int64)
        which = np.frombuffer(pieces, np.int32)
        lengths = self.lengths[which]
        total = np.concatenate(([0], np.cumsum(lengths)))
        return gather(self.flat, self.starts[which], lengths), total[np.concatenate(([0], np.cumsum(counts)))]


_replays: list[tuple[tuple[str, int, int], MergeReplay]] = []


def _replay(shared, pattern: str) -> MergeReplay:
    """The worker's MergeReplay of this broadcast and pattern."""
    ranks = shared.value
    key = (pattern, len(ranks), hash(frozenset(ranks.items())))
    if not _replays or _replays[0][0] != key:
        _replays[:] = [(key, MergeReplay(ranks, pattern))]
    return _replays[0][1]


class Decoder:
    """Bytes of lists of ids."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.lengths = np.array([len(x) for x in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def __call__(self, which: np.ndarray, offsets: np.ndarray) -> pa.Array:
        sizes = np.concatenate(([0], np.cumsum(self.lengths[which])))
        data = gather(self.flat, self.starts[which], self.lengths[which])
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(sizes[offsets].astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def encode(df: DataFrame, text: str, ranks: dict[bytes, int], pattern: str, keep: list[str], ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """The columns ``keep`` and the token ids of ``text`` as ``array<int>``;
    with ``decoded`` also the bytes that the ids stand for, in the same pass.

    A null or empty text has no ids. Repeated rows stay repeated, an empty
    table gives an empty one, and other columns of ``df`` don't matter.
    """
    spark = df.sparkSession
    for_python(spark)
    shared = spark.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _replay(shared, pattern)
        decoder = Decoder(shared.value) if decoded else None
        flat = offsets = lists = batch = None
        for batch in batches:
            flat, offsets = coder.encode(batch.column(0).to_pylist())
            lists = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(flat, pa.int32())).cast(pa.list_(pa.int32()))
            back = [decoder(flat, offsets)] if decoder else []
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], lists, *back], names=[*keep, ids, *([decoded] if decoded else [])])
        del flat, offsets, lists, batch, decoder
        coder.forget()
        release_memory()

    narrow = df.select(F.col(text).alias("__text"), *keep)
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(ids, T.ArrayType(T.IntegerType())), *([T.StructField(decoded, T.BinaryType())] if decoded else [])])
    return narrow.mapInArrow(run, schema)


def decode(df: DataFrame, ids: str, ranks: dict[bytes, int], keep: list[str], out: str = "decoded") -> DataFrame:
    """The columns ``keep`` and the bytes of the token ids as ``binary``.

    Null ids count as none; an id outside the vocabulary is an error.
    """
    for_python(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in batches:
            lists = batch.column(0).fill_null([])
            offsets = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))))
            made = decoder(lists.flatten().to_numpy(zero_copy_only=False), offsets)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], made], names=[*keep, out])
        lists = made = batch = None
        release_memory()

    narrow = df.select(F.col(ids).alias("__ids"), *keep)
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, T.BinaryType())])
    return narrow.mapInArrow(run, schema)
