"""Byte-level BPE encoding and decoding.

Encoding replays merges over a corpus chunk at once. The chunk's distinct pieces are laid out in one array of
symbols; an inverted index goes from each mergeable pair (by the rank of the token it makes) to the positions
where it stands. The lowest rank is taken first, all its positions are merged, and only the touched neighbours
are entered anew. That equals the usual per-piece rule (lowest rank first, leftmost first), because pieces are
independent and each sees its own pairs in that order.

Chunks are bounded in characters, so that there is no shuffle and a task's memory doesn't depend on the corpus.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, rows_of

#: Characters of text whose distinct pieces are encoded together, and distinct pieces at most.
CHUNK_CHARS, CHUNK_PIECES = 8 << 20, 250_000
#: Longer texts are cut into pieces part by part.
PART_CHARS = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes by rank from a file with a base64 token and its rank on each line; read where the driver runs."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of values that begin at starts and have these sizes, one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts - ends + sizes, sizes) + np.arange(total)]


class MergeReplay:
    """Applies the merges of `ranks` to sets of byte strings."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pair = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pair[a << 32 | b] = rank
        self.keys = np.array(sorted(pair), np.int64)
        self.made = np.array([pair[k] for k in self.keys.tolist()], np.int64)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank that each pair makes; -1 if none (or if one side is no symbol)."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.made[at], -1)

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The token ids of all pieces, one after the other, and how many each has."""
        if not pieces:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        # -1 stands between pieces, -2 for a symbol that was swallowed.
        sym = np.full(int(sizes.sum()) + len(pieces) + 1, -1, np.int64)
        piece = np.repeat(np.arange(len(pieces)), sizes)
        at = np.arange(len(piece)) + piece
        sym[at] = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        starts = np.cumsum(sizes) - sizes + np.arange(len(pieces))
        for i, whole in enumerate(map(self.ranks.get, pieces)):
            if whole is not None:
                sym[starts[i] : starts[i] + sizes[i]] = -2
                sym[starts[i]] = whole
        after, before = np.arange(1, len(sym) + 1), np.arange(-1, len(sym) - 1)
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def enter(positions: np.ndarray, ranks: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            positions, ranks = positions[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            lo = 0
            for hi in [*cuts.tolist(), len(ranks)]:
                rank = int(ranks[lo])
                if rank in index:
                    index[rank].append(positions[lo:hi])
                else:
                    index[rank] = [positions[lo:hi]]
                    heapq.heappush(queue, rank)
                lo = hi

        ranks = self.pair_ranks(sym[:-1], sym[1:])
        first = np.flatnonzero(ranks >= 0)
        if len(first):
            enter(first, ranks[first])
        while queue:
            rank = heapq.heappop(queue)
            lists = index.pop(rank)
            pos = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            left, nxt = sym[pos], after[pos]
            good = self.pair_ranks(left, sym[nxt]) == rank
            if not good.all():
                pos, nxt = pos[good], nxt[good]
            if not len(pos):
                continue
            if len(pos) > 1 and (touch := nxt[:-1] == pos[1:]).any():
                # A run of overlapping positions: every second one, from the left.
                run_start = np.append(True, ~touch)
                in_run = np.arange(len(pos)) - np.maximum.accumulate(np.where(run_start, np.arange(len(pos)), 0))
                pos, nxt = pos[in_run % 2 == 0], nxt[in_run % 2 == 0]
            beyond = after[nxt]
            sym[pos] = rank
            sym[nxt] = -2
            after[pos] = beyond
            before[beyond] = pos
            prev = before[pos]
            made = self.pair_ranks(np.concatenate([sym[pos], sym[prev]]), np.concatenate([sym[beyond], sym[pos]]))
            new = made >= 0
            if new.any():
                enter(np.concatenate([pos, prev])[new], made[new])
        kept = sym >= 0
        count = np.add.reduceat(kept[:-1].astype(np.int64), starts)
        return sym[kept], np.where(sizes > 0, count, 0)


_REPLAYS: dict[int, MergeReplay] = {}


def replay_of(ranks: dict[bytes, int]) -> MergeReplay:
    """One MergeReplay for each worker process and set of ranks."""
    key = hash(frozenset(ranks.items()))
    if key not in _REPLAYS:
        _REPLAYS.clear()
        _REPLAYS[key] = MergeReplay(ranks)
    return _REPLAYS[key]


_CUT = regex.compile(r"(?<=\S) (?=\S)")


def safe_parts(text: str, most: int = PART_CHARS) -> Iterator[str]:
    """text in parts, cut only before a single space between two other characters, where a piece always begins."""
    start = 0
    while len(text) - start > most:
        cut = _CUT.search(text, start + most)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


class Codes(dict):
    """Numbers pieces in the order in which they come up."""

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self)
        return n


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every whole text: (id_col, ids array<int>), one row per input row.

    A null or empty text gives an empty array; ids may repeat or be null; other columns are not carried. The
    pattern's matches are encoded separately and what it doesn't match gives no tokens. Ranks must hold all 256
    bytes. `pattern` must begin a piece at a single space that stands between two other characters, as the
    public patterns do (long texts are cut there). The ranks (a fixed vocabulary) are broadcast.
    """
    if len(ranks) > 2_000_000:
        raise ValueError("the vocabulary is too large to broadcast")
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay, find = replay_of(shared.value), regex.compile(pattern).findall
        codes, keys, held, length = Codes(), [], [], 0
        key_type = pa.null()

        def ready() -> Iterator[pa.RecordBatch]:
            nonlocal codes, length
            values, sizes = replay.encode([p.encode("utf-8", "replace") for p in codes])
            starts = np.cumsum(sizes) - sizes
            for at in range(0, len(keys), 512):
                part = held[at : at + 512]
                code = np.concatenate(part)
                ids = gathered(values, starts[code], sizes[code]).astype(np.int32)
                own = np.append(0, np.cumsum(sizes[code]))
                ends = np.append(0, np.cumsum([len(c) for c in part]))
                lists = pa.ListArray.from_arrays(pa.array(own[ends].astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 512], key_type), lists], [id_col, "ids"])
            codes, length = Codes(), 0
            keys.clear()
            held.clear()

        for batch in batches:
            key_type = batch.schema.field(0).type
            for key, text in rows_of([batch]):
                text = text or ""
                own = [np.array(list(map(codes.__getitem__, find(part))), np.int32) for part in safe_parts(text)]
                keys.append(key)
                held.append(own[0] if len(own) == 1 else np.concatenate(own))
                length += len(text)
                if length > CHUNK_CHARS or len(codes) > CHUNK_PIECES:
                    yield from ready()
        yield from ready()

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(lean(run), f"`{id_col}` {kind}, ids array<int>")


def decode(encoded: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The encoded rows with `decoded` (binary): the bytes of their ids, joined.

    Null or empty ids give empty bytes; an id that isn't in the vocabulary raises KeyError.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_id = {r: t for t, r in shared.value.items()}
        sizes = np.full(max(by_id) + 1, -1, np.int64)
        for r, t in by_id.items():
            sizes[r] = len(t)
        data = np.frombuffer(b"".join(by_id.get(r, b"") for r in range(len(sizes))), np.uint8)
        starts = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = part.column(1)
                flat, counts = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64), ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                if len(flat) and (flat.min() < 0 or flat.max() >= len(sizes) or sizes[flat].min() < 0):
                    raise KeyError("an id that isn't in the vocabulary")
                out = gathered(data, starts[flat], sizes[flat])
                own = np.append(0, np.cumsum(sizes[flat]))
                ends = own[np.append(0, np.cumsum(counts))]
                found = pa.Array.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(out)])
                yield pa.RecordBatch.from_arrays([part.column(0), ids, found.cast(pa.binary())], [id_col, ids_col, "decoded"])

    return encoded.select(id_col, ids_col).mapInArrow(lean(run), f"`{id_col}` {kind}, `{ids_col}` array<int>, decoded binary")


def digest(decoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row: id, n_tokens, ids_sha256 of the decimal ids joined by one space, decoded_sha256."""
    ids: Column = F.col("ids")
    return decoded.select(
        F.col(id_col),
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(ids.cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
