"""LM scoring by online logistic context mixing, in bits per byte.

A text is its UTF-8 bytes and an end byte, cut into tokens that each end with a white-space byte or the end byte. A token
has a state, which is what came before it: where in a sentence it stands (how the token before ends), and the latest letter
beyond ASCII, which tells languages apart. Five predictors guess each bit from contexts: one, two and three bytes
before (the place in the sentence stands before a token's first byte), the whole beginning of the token with
the place, and with the whole state. Their guesses are mixed in the logistic domain by weights that a gate selects
(how well the longer contexts are known, bit position, first byte or later), and an adaptive table refines the mixture.
All the bits' costs sum up.

Because contexts end at a token's state, a token's cost is a function of the token and its state. So all tokens of the texts
and of the training documents are gathered as one table of distinct (state, token) with their training counts (it grows
with the corpus and stays distributed), dealt into parts of about PART tokens, each a range in the order of place and bytes:

1. Each part names the (context, next byte) pairs of its tokens. A whole beginning stands in one part only, unless its
   first or last token begins with it too; such pairs, and those of up to three bytes, are sent with their counts to
   buckets of contexts. A bucket sums up what all parts sent and answers each part with the counts along the
   path of each pair's bits. No context shares counts with another: those of up to three bytes are named as they are, whole
   beginnings by a hash of 54 bits. Nothing of this is broadcast or collected.
2. The weights are learned online, token batch after token batch, in runs of parts, and averaged. A token's own
   occurrence is taken out of the counts first, so that the weights suit texts not seen.
3. Each part works out the costs of its tokens, and the counts of their words are joined to them.

Scoring is a scan with the FREQUENT most frequent tokens broadcast; all other tokens of a text are joined by their
64-bit names with their costs and counts by a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucket_bounds, bucketwise, exchanged, lean, mixed, most_frequent, rows_of, sliced, staged

PREDICTORS = 5
#: Slots of each predictor's table in a mixer that holds counts itself.
SLOT_BITS = 19
SLOTS = 1 << SLOT_BITS
#: Tokens whose costs and counts are broadcast, and slots of the table in which a task looks them up.
FREQUENT, LOOKUP_BITS = 300_000, 21
#: Tokens of a part, whose counts are held at once, and tokens on which weights are learned by one task.
PART, PART_TOKENS = 50_000, 400_000
#: Bytes of text that are cut into tokens at once, and tokens that are counted at once.
CUT, HELD = 1 << 18, 1_500_000
#: (Context, next byte) pairs of a bucket, about; how many a token has, as parts send them.
PAIRS, TOKEN_PAIRS = 150_000, 1
PRIOR, CLIP, RATE, BUCKETS = 0.35, 8.0, 0.02, 33
#: Levels of confidence: how often the beginning was seen with the place (if not, whether three bytes were), times how
#: often with the whole state.
SEEN = (1, 2, 4, 16)
LEVELS = (2 + len(SEEN)) * (1 + len(SEEN))
GATES = LEVELS * 8 * 2
END = b"\xff"
TOKEN = re.compile(rb"[^\xff\x09-\x0d ]*[\xff\x09-\x0d ]")
_SEPARATES = bytes(b in b"\xff\x09\x0a\x0b\x0c\x0d " for b in range(256))
_SPECIAL = bytes(0xC2 <= b <= 0xF4 for b in range(256))
#: Places of a token: at the start of a text, after the end of a sentence, at the start of a line, elsewhere.
START, SENTENCE, LINE, ELSEWHERE = range(4)
_TOKENS = -1  # the bucket of the rows that hold a part's tokens


def tokens_of(text: str | None) -> list[bytes]:
    """The tokens of a text; joined and without the last byte they are its UTF-8 bytes."""
    return TOKEN.findall((text or "").encode("utf-8", "replace") + END)


def states_of(tokens: list[bytes]) -> list[int]:
    """The state of each token of a text: its place times 65536, plus the latest letter beyond ASCII before it (0 without one)."""
    out, place, letter = [], START, 0
    for t in tokens:
        out.append(place << 16 | letter)
        place = SENTENCE if t[-2:-1] in (b".", b"!", b"?", b":") else LINE if t[-1:] == b"\n" else ELSEWHERE
        for i, b in enumerate(t[:-1]):
            if 0xC2 <= b <= 0xF4:
                letter = b << 8 | (t[i + 1] if b < 0xC8 else 0)
    return out


class Cut:
    """All tokens of many texts (their bytes): where each starts, its size, its text, its state, and a 64-bit name of state and token."""

    def __init__(self, texts: list[bytes]):
        data = END.join(texts) + END
        ends = np.flatnonzero(np.frombuffer(data.translate(_SEPARATES), np.bool_)) + 1
        self.data = np.frombuffer(data, np.uint8)
        self.start = np.append(0, ends[:-1])
        self.size = ends - self.start
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.bounds = np.searchsorted(self.start, begins[:-1])  # the first token of each text
        self.text = np.repeat(np.arange(len(texts)), np.diff(np.append(self.bounds, len(ends))))
        last, mark = (self.data[np.maximum(self.start - k, 0)] for k in (1, 2))
        ended = np.append(1, self.size[:-1]) > 1
        place = np.where(ended & np.isin(mark, np.frombuffer(b".!?:", np.uint8)), SENTENCE, np.where(last == 10, LINE, ELSEWHERE))
        place[self.bounds] = START
        special = np.flatnonzero(np.frombuffer(data.translate(_SPECIAL), np.bool_))
        lead = self.data[special].astype(np.int64)
        letter = lead << 8 | np.where(lead < 0xC8, self.data[np.minimum(special + 1, len(data) - 1)], 0)
        at = np.searchsorted(special, self.start) - 1
        there = (at >= 0) & (np.append(special, 0)[at] >= begins[:-1][self.text])
        self.state = place << 16 | np.where(there, np.append(letter, 0)[at], 0)
        self.name = names_of(data, self.start, self.size, self.state)

    def tokens(self, chosen: np.ndarray) -> pa.Array:
        """Some tokens as an Arrow array."""
        size = self.size[chosen]
        ends = np.cumsum(size)
        places = np.repeat(self.start[chosen] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        offsets = np.append(0, ends).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(chosen), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(self.data[places].tobytes())])


def names_of(data: bytes, start: np.ndarray, size: np.ndarray, state: np.ndarray) -> np.ndarray:
    """64-bit names of tokens of data with their states, from eight bytes at a time."""
    eight = np.ndarray((len(data) + 1,), "<u8", buffer=data + bytes(8), strides=(1,))
    first = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    with np.errstate(over="ignore"):
        h = mixed((eight[start] & first[np.minimum(size, 8)]) + mixed(state.astype(np.uint64) << np.uint64(32) | size.astype(np.uint64)))
        at, more = 8, np.flatnonzero(size > 8)
        while len(more):
            part = eight[start[more] + at] & first[np.minimum(size[more] - at, 8)]
            h[more] = mixed(h[more] * np.uint64(0xC2B2AE3D27D4EB4F) ^ part)
            at += 8
            more = more[size[more] > at]
    return h


_R = np.uint64(0x9E3779B97F4A7C15)
_R_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@dataclass
class Bits:
    """The bits of a batch of tokens: the (context, next byte) pair by predictor and byte; the bit; which gate without the longest context; the token of each byte."""

    pairs: np.ndarray  # predictors x bytes
    ones: np.ndarray  # 8 x bytes, bool
    later: np.ndarray  # bytes, bool: not the first byte of its token
    token: np.ndarray  # bytes


#: Orders of the contexts of bytes, and the tags of whole beginnings, by place and by state.
ORDERS = (1, 2, 3)
_BY_PLACE, _BY_STATE = np.uint64(1 << 54), np.uint64(1 << 55)
_BASE = np.uint64(264)  # bytes plus one, and places


def bits_of(tokens: list[bytes], states: np.ndarray) -> Bits:
    data = np.frombuffer(b"".join(tokens), np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    token = np.repeat(np.arange(len(tokens)), sizes)
    starts = np.cumsum(sizes) - sizes
    at = np.arange(len(data)) - starts[token]
    states = np.asarray(states, np.uint64)
    place = (states >> np.uint64(16))[token]
    with np.errstate(over="ignore"):
        contexts, total = [], np.zeros(len(data), np.uint64)
        for k in ORDERS:
            earlier = np.concatenate([np.zeros(min(k, len(data)), np.uint64), data[: max(0, len(data) - k)]]) + np.uint64(1)
            total = total * _BASE + np.where(at >= k, earlier, np.where(at == k - 1, np.uint64(257) + place, np.uint64(0)))
            contexts.append(np.uint64((k - 1) << 25) | total)
        # Hash of the beginning: a sum of byte * R^-position, brought to the token's start.
        back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(data), _R_INVERSE, np.uint64)]))[: len(data)]
        forth = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(data), _R, np.uint64)]))[: len(data)]
        total = np.concatenate([[np.uint64(0)], np.cumsum((data + np.uint64(1)) * back)])
        begin = (total[np.arange(len(data))] - total[starts[token]]) * forth[starts[token]] if len(data) else data
        begin = mixed(begin)
        contexts.append(_BY_PLACE | mixed(begin + mixed(place)) >> np.uint64(10))
        contexts.append(_BY_STATE | mixed(begin + mixed(states)[token]) >> np.uint64(10))
        pairs = np.stack([c << np.uint64(8) | data for c in contexts])
    ones = np.stack([(data >> np.uint64(7 - j) & np.uint64(1)).astype(bool) for j in range(8)])
    return Bits(pairs, ones, at > 0, token)


def paths(pairs: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For sorted, distinct pairs with counts: how often the context comes with the first 0 to 8 bits of the next byte (9 x pairs)."""
    out = np.empty((9, len(pairs)))
    for j in range(9):
        start = np.flatnonzero(np.append(True, np.diff(pairs >> np.uint64(8 - j)) > 0))
        out[j] = np.repeat(np.add.reduceat(n, start), np.diff(np.append(start, len(pairs)))) if len(pairs) else 0
    return out


def guessed(zeros: np.ndarray, ones: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Predictor i's stretched guesses from counts of zeros and ones, and its share in the level of confidence."""
    n, level = zeros + ones, np.zeros(zeros.shape, np.uint8)
    if i == PREDICTORS - 3:
        level[n > 0] = 1
    elif i == PREDICTORS - 2:
        for k, least in enumerate(SEEN, 2):
            level[n >= least] = k
    elif i == PREDICTORS - 1:
        for k, least in enumerate(SEEN, 1):
            level[n >= least] = k * (2 + len(SEEN))
    return np.clip(np.log((ones + PRIOR) / (zeros + PRIOR)), -CLIP, CLIP).astype(np.float32), level


def guessed_pairs(pairs: np.ndarray, path: np.ndarray, without: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Guesses and levels (pairs x 8) of sorted pairs with their paths; without: as if each bit's own occurrence were not counted."""
    guess, level = np.empty((len(pairs), 8), np.float32), np.empty((len(pairs), 8), np.uint8)
    tags = np.array([*((k - 1) << 33 for k in ORDERS[1:]), 1 << 62, 1 << 63], np.uint64)
    bounds = [0, *np.searchsorted(pairs, tags).tolist(), len(pairs)]
    for i, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False)):
        same, other = path[lo:hi, 1:], path[lo:hi, :-1] - path[lo:hi, 1:]
        if without:
            same = np.maximum(same - 1, 0)
        bit = (pairs[lo:hi, None] >> np.arange(7, -1, -1).astype(np.uint64) & np.uint64(1)).astype(bool)
        guess[lo:hi], level[lo:hi] = guessed(np.where(bit, other, same), np.where(bit, same, other), i)
    return guess, level


@dataclass
class Mixer:
    """Weights by gate; the refinement's table of probabilities; counts of zeros and ones by predictor and slot, of use only where no exact ones are given."""

    zeros: np.ndarray
    ones: np.ndarray
    weights: np.ndarray
    refined: np.ndarray

    @staticmethod
    def fresh(zeros: np.ndarray, ones: np.ndarray) -> Mixer:
        start = np.tile(np.array([0.0, 0.05, 0.1, 0.5, 0.4], np.float32), (GATES, 1))
        return Mixer(zeros, ones, start, identity())

    def looked_up(self, b: Bits) -> tuple[np.ndarray, np.ndarray]:
        """Guesses and levels (predictors x 8 x bytes) from the mixer's own hashed tables."""
        node = np.stack([np.uint64(1 << j) | (b.pairs[0] & np.uint64(255)) >> np.uint64(8 - j) for j in range(8)])
        with np.errstate(over="ignore"):
            slots = mixed((b.pairs >> np.uint64(8))[:, None] * _R + node) >> np.uint64(64 - SLOT_BITS)
        return tuple(map(np.stack, zip(*(guessed(self.zeros[i][slots[i]], self.ones[i][slots[i]], i) for i in range(PREDICTORS)), strict=True)))

    def refine(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of a one: the mixture and the table's value there, half and half."""
        half = x.dtype.type(0.5)
        p = half / (1 + np.exp(-x))
        return p + half * self.refined.astype(x.dtype)[np.arange(8)[:, None], bucket_of(x)]

    def costs(self, tokens: list[bytes], states: np.ndarray, said: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """log10 of the probability of each token in its state; said: guesses and levels of its bits (predictors x 8 x bytes)."""
        if not tokens:
            return np.zeros(0)
        b = bits_of(tokens, states)
        guess, level = said or self.looked_up(b)
        gate = gates(level, b)
        weights = np.ascontiguousarray(self.weights.T)
        x = weights[0][gate] * guess[0]
        for i in range(1, PREDICTORS):
            x += weights[i][gate] * guess[i]
        p = self.refine(np.clip(x, -CLIP, CLIP))
        bit = np.log10(np.where(b.ones, p, 1 - p)).sum(0)
        return np.bincount(b.token, bit, len(tokens))


def gates(level: np.ndarray, b: Bits) -> np.ndarray:
    known = np.maximum(level[-3], level[-2]).astype(np.int32) + level[-1]
    return (known * 8 + np.arange(8, dtype=np.int32)[:, None]) * 2 + b.later


def identity() -> np.ndarray:
    return np.tile(1 / (1 + np.exp(-np.linspace(-CLIP, CLIP, BUCKETS))), (8, 1))


def bucket_of(x: np.ndarray) -> np.ndarray:
    return np.rint((x + CLIP) * ((BUCKETS - 1) / (2 * CLIP))).astype(np.int32)


def cuts(rows: Iterable[tuple]) -> Iterator[tuple[list[tuple], Cut]]:
    """Rows (text as bytes or null, ...) in lists of about CUT bytes, and the tokens of each list."""
    for held in sliced(rows, lambda r: 64 + len(r[0] or b""), CUT):
        yield held, Cut([r[0] or b"" for r in held])


def with_bytes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with their first column, texts, as bytes."""
    for b in batches:
        yield b.set_column(0, b.schema.names[0], b.column(0).cast(pa.binary()))


def gather_tokens(texts: DataFrame) -> DataFrame:
    """(state int, token binary, n long): every distinct token of texts (text, whether it is for training) in each of its states, and how often it comes in those for training."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            name, n, state = (np.concatenate(x) for x in list(zip(*held, strict=True))[:3])
            token = pa.concat_arrays([x[3] for x in held])
            held.clear()
            order = np.argsort(name)
            first = np.flatnonzero(np.append(True, name[order][1:] != name[order][:-1]))
            total = np.add.reduceat(n[order], first)
            for at in range(0, len(first), 50_000):
                some = order[first[at : at + 50_000]]
                yield pa.RecordBatch.from_arrays([pa.array(state[some].astype(np.int32)), token.take(pa.array(some)), pa.array(total[at : at + 50_000])], ["state", "token", "n"])

        for rows, cut in cuts(rows_of(with_bytes(batches))):
            training = np.array([bool(r[1]) for r in rows], np.int64)[cut.text]
            order = np.argsort(cut.name)
            first = np.flatnonzero(np.append(True, cut.name[order][1:] != cut.name[order][:-1]))
            some = order[first]
            held.append((cut.name[some], np.add.reduceat(training[order], first), cut.state[some], cut.tokens(some)))
            size += len(some)
            if size > HELD:
                yield from out()
                size = 0
        if held:
            yield from out()

    return texts.mapInArrow(lean(run), "state int, token binary, n long").groupBy("state", "token").agg(F.sum("n").alias("n"))


def word_counts(tokens: DataFrame) -> DataFrame:
    """(word binary, c long) from the token table: lower-cased (A-Z) words; a single space stands for the end of a text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for t, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if w := t[:-1].lower():
                    found[w] += n
                if t[-1:] == END:
                    found[b" "] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "c"])

    return tokens.select("token", "n").mapInArrow(lean(run), "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def parts_of(tokens: DataFrame, parts: int) -> DataFrame:
    """(part int, bucket int, blob binary): the tokens (state, token, n) of each part, in the order of place, token and state."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(rows_of(batches))  # about PART tokens
        if held:
            states, names, n = zip(*held, strict=True)
            yield blobs([TaskContext.get().partitionId()], [_TOKENS], [np.array([len(names), *map(len, names), *n, *states], np.int64).tobytes() + b"".join(names)])

    place = F.shiftright("state", 16)
    return tokens.repartitionByRange(parts, place, "token").sortWithinPartitions(place, "token", "state").select("state", "token", "n").mapInArrow(lean(pack), BLOBS)


BLOBS = "part int, bucket int, blob binary"


def blobs(part: list, bucket: list, blob: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(bucket, pa.int32()), pa.array(blob, pa.binary())], ["part", "bucket", "blob"])


def unpacked(blob: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The tokens of a part, their counts and their states."""
    size = int(np.frombuffer(blob, np.int64, 1)[0])
    sizes, n, states = np.frombuffer(blob, np.int64, 3 * size, 8).reshape(3, size)
    ends = (8 + 24 * size + np.cumsum(sizes)).tolist()
    return [blob[a:b] for a, b in zip([8 + 24 * size, *ends], ends, strict=False)], n, states


def at_the_edge(tokens: list[bytes], states: np.ndarray, b: Bits) -> np.ndarray:
    """Which bytes of a part's tokens have a beginning before them with which its first or last token begins as well, in the same place."""
    if not tokens:
        return np.zeros(0, bool)
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    starts = np.cumsum(size) - size
    at = np.arange(len(b.token)) - starts[b.token]
    data, place = (b.pairs[0] & np.uint64(255)).astype(np.int64), states >> 16
    out = np.zeros(len(at), bool)
    for k in (0, len(tokens) - 1):
        edge = np.frombuffer(tokens[k], np.uint8).astype(np.int64)
        same = (at < len(edge)) & (data == edge[np.minimum(at, len(edge) - 1)])
        shared = np.minimum.reduceat(np.where(same, len(at), at), starts)  # where a token first differs
        out |= (at <= shared[b.token]) & (place == place[k])[b.token]
    return out


@dataclass
class Pairs:
    """The distinct pairs of a part (sorted), which of them each byte is for each predictor, their counts in the part, and those that other parts may have too, by bucket."""

    pairs: np.ndarray
    of: np.ndarray
    total: np.ndarray
    shared: np.ndarray
    buckets: np.ndarray
    bounds: np.ndarray


def pairs_of(tokens: list[bytes], n: np.ndarray, states: np.ndarray, buckets: int) -> tuple[Bits, Pairs]:
    b = bits_of(tokens, states)
    found, of, size = [], np.empty(b.pairs.shape, np.int32), 0
    for i, mine in enumerate(b.pairs):  # predictors' pairs don't overlap, and ascend
        one, back = np.unique(mine, return_inverse=True)
        found.append(one)
        of[i] = back + size
        size += len(one)
    pairs = np.concatenate(found)
    total = np.bincount(of.ravel(), np.tile(n[b.token].astype(np.float64), PREDICTORS), len(pairs))
    asked = pairs < np.uint64(1 << 62)
    asked[of[PREDICTORS - 2 :, at_the_edge(tokens, states, b)].ravel()] = True
    asked = np.flatnonzero(asked)
    by, present, bounds = bucket_bounds(mixed(pairs[asked] >> np.uint64(8)), buckets)
    return b, Pairs(pairs, of, total, asked[by], present, bounds)


def answers(parts: DataFrame, buckets: int) -> DataFrame:
    """(part, bucket, blob): for the pairs of each part by bucket, the counts over all parts along their paths."""

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, blob in rows_of(b.slice(i, 1) for b in batches for i in range(b.num_rows)):
            own = pairs_of(*unpacked(blob), buckets)[1]
            for bucket, lo, hi in zip(own.buckets.tolist(), own.bounds, own.bounds[1:], strict=False):
                x = own.shared[lo:hi]
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([part], pa.int32()), pa.array([own.pairs[x].tobytes() + own.total[x].tobytes()], pa.binary())], ["bucket", "part", "blob"])

    def answer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in bucketwise(batches):
            asked = [np.frombuffer(blob, np.uint64, len(blob) // 16) for _, blob in rows]
            pairs, inverse = np.unique(np.concatenate(asked), return_inverse=True)
            path = paths(pairs, np.bincount(inverse, np.concatenate([np.frombuffer(blob, np.float64, len(blob) // 16, len(blob) // 2) for _, blob in rows]), len(pairs)))
            steps, at = np.diff(path, axis=0, prepend=0.0), 0  # mostly zeros
            for (part, _), x in zip(rows, asked, strict=True):
                yield blobs([part], [bucket], [pa.compress(np.ascontiguousarray(steps[:, inverse[at : at + len(x)]]), "zstd", asbytes=True)])
                at += len(x)

    return exchanged(parts.mapInArrow(lean(ask), "bucket long, part int, blob binary"), buckets).mapInArrow(lean(answer), BLOBS)


def known_parts(rows: DataFrame, tasks: int) -> DataFrame:
    """The rows of a part, its tokens first, one after the other."""
    return rows.repartition(tasks, "part").sortWithinPartitions("part", "bucket")


@dataclass
class Part:
    """Tokens, their counts and states; where each starts in the bytes; the pair of each byte for each predictor; the pairs and their paths."""

    tokens: list[bytes]
    n: np.ndarray
    states: np.ndarray
    starts: np.ndarray
    of: np.ndarray  # predictors x bytes
    pairs: np.ndarray
    path: np.ndarray  # pairs x 9

    def batches(self, size: int, training: bool) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]]:
        """Batches of `size` tokens, their counts, states, and guesses and levels of their bits (predictors x 8 x bytes); training: only tokens that count, as if each bit's own occurrence were not counted."""
        chosen = np.flatnonzero(self.n > 0) if training else np.arange(len(self.tokens))
        if training:  # neighbours are alike
            chosen = np.random.default_rng(len(chosen)).permutation(chosen)
        said, sizes = guessed_pairs(self.pairs, self.path, training), np.diff(self.starts)
        for at in range(0, len(chosen), size):
            part = chosen[at : at + size]
            ends = np.cumsum(sizes[part])
            places = np.repeat(self.starts[part] - ends + sizes[part], sizes[part]) + np.arange(ends[-1])
            of = self.of[:, places]
            yield [self.tokens[i] for i in part.tolist()], self.n[part], self.states[part], tuple(np.ascontiguousarray(np.moveaxis(x[of], 2, 1)) for x in said)


def known_tokens(batches: Iterable[pa.RecordBatch], buckets: int) -> Iterator[Part]:
    for _, rows in bucketwise(batches):
        tokens, n, states = unpacked(rows[0][1])
        b, own = pairs_of(tokens, n, states, buckets)
        path = np.empty((len(own.pairs), 9))
        alone = np.ones(len(own.pairs), bool)
        alone[own.shared] = False
        path[alone] = paths(own.pairs[alone], own.total[alone]).T
        for (bucket, blob), want, lo, hi in zip(rows[1:], own.buckets.tolist(), own.bounds[:-1], own.bounds[1:], strict=True):
            if bucket != want:
                raise ValueError("answers of a part don't fit its pairs")
            steps = np.frombuffer(pa.decompress(blob, 72 * int(hi - lo), "zstd")).reshape(9, -1)
            path[own.shared[lo:hi]] = np.cumsum(steps, 0).T
        yield Part(tokens, n, states, np.searchsorted(b.token, np.arange(len(tokens) + 1)), own.of, own.pairs, path)


def train(known: DataFrame, n_tokens: int, buckets: int) -> Mixer:
    """A mixer from parts (known: their tokens and answers) of n_tokens tokens; without any that count it knows nothing."""
    spark = known.sparkSession
    tasks = max(1, -(-n_tokens // PART_TOKENS))
    nothing = np.zeros((PREDICTORS, 0), np.float32)  # counts come from the parts
    fresh = Mixer.fresh(nothing, nothing)
    shared = spark.sparkContext.broadcast(fresh)

    def learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        weights, squares = model.weights.astype(np.float64), np.full(model.weights.shape, 1.0)
        seen, hits = np.zeros(8 * BUCKETS), np.zeros(8 * BUCKETS)
        done = 0.0
        for tokens, n, states, (guess, level) in (x for part in known_tokens(batches, buckets) for x in part.batches(512, True)):
            b = bits_of(tokens, states)
            w = n[b.token].astype(np.float64)
            gate = gates(level, b)
            x = np.clip(sum(weights[gate, i] * guess[i] for i in range(PREDICTORS)), -CLIP, CLIP)
            off = (b.ones - 1 / (1 + np.exp(-x))) * w
            flat = gate.ravel()
            for i in range(PREDICTORS):
                grad = np.bincount(flat, (off * guess[i]).ravel(), GATES)
                squares[:, i] += grad**2
                weights[:, i] += RATE * grad / np.sqrt(squares[:, i])
            bucket = (np.arange(8)[:, None] * BUCKETS + bucket_of(x)).ravel()
            spread = np.broadcast_to(w, b.ones.shape)
            seen += np.bincount(bucket, spread.ravel(), 8 * BUCKETS)
            hits += np.bincount(bucket, (spread * b.ones).ravel(), 8 * BUCKETS)
            done += w.sum()
        if done:
            yield pa.RecordBatch.from_pydict({"g": [0], "c": [np.concatenate([weights.ravel() * done, seen, hits, [done]]).tobytes()]}, pa.schema([("g", pa.int32()), ("c", pa.binary())]))

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for _, blob in rows_of(batches):
            part = np.frombuffer(blob)
            held = part if held is None else held + part
        if held is not None:
            yield pa.RecordBatch.from_pydict({"g": [0], "c": [held.tobytes()]}, pa.schema([("g", pa.int32()), ("c", pa.binary())]))

    groups = max(1, round(tasks**0.5))
    learned = known_parts(known, tasks).mapInArrow(lean(learn), "g int, c binary").withColumn("g", F.pmod(F.spark_partition_id(), F.lit(groups))).repartition(groups, "g").mapInArrow(lean(add), "g int, c binary")
    got = sorted(bytes(r["c"]) for r in learned.collect())  # about the root of the number of parts, 15 KB each
    if not got:
        return fresh
    held = np.sum([np.frombuffer(x) for x in got], 0)
    cut = GATES * PREDICTORS
    seen, hits = held[cut : cut + 8 * BUCKETS], held[cut + 8 * BUCKETS : -1]
    start = identity().ravel()
    refined = ((hits + 20 * start) / (seen + 20)).reshape(8, BUCKETS)
    return Mixer(nothing, nothing, (held[:cut] / held[-1]).reshape(GATES, PREDICTORS).astype(np.float32), np.clip(refined, 1e-5, 1 - 1e-5))


def token_costs(known: DataFrame, parts: int, buckets: int, mixer: Mixer) -> DataFrame:
    """(name, n, word, cost): the name of every token in its state, its lower-cased (A-Z) word (null without one) and log10 of its probability."""
    model = known.sparkSession.sparkContext.broadcast(mixer)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, n, states, said in (x for part in known_tokens(batches, buckets) for x in part.batches(4096, False)):
            words = [t[:-1].lower() or None for t in tokens]
            size = np.fromiter(map(len, tokens), np.int64, len(tokens))
            name = names_of(b"".join(tokens), np.cumsum(size) - size, size, states)
            yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(n), pa.array(words, pa.binary()), pa.array(model.value.costs(tokens, states, said))], ["name", "n", "word", "cost"])

    return known_parts(known, parts).mapInArrow(lean(run), "name long, n long, word binary, cost double")


class Lookup:
    """Costs and words' counts of frequent tokens by name, in a table addressed by the highest bits; where two share a place, one is left out, and counts as rare."""

    def __init__(self, name: np.ndarray, cost: np.ndarray, c: np.ndarray):
        self.name = name.view(np.uint64)
        self.cost, self.counted = np.append(cost, 0.0), np.append(c > 0, False)
        self.log = np.append(np.log10(np.maximum(c, 0) + 0.1), 0.0)
        self.at = np.full(1 << LOOKUP_BITS, -1, np.int32)
        order = np.arange(len(name))[::-1]  # the first, most frequent one of a place is written last
        self.at[self.name[order] >> np.uint64(64 - LOOKUP_BITS)] = order

    def find(self, name: np.ndarray) -> np.ndarray:
        """The number of each name; -1 for those that aren't here."""
        if not len(self.name):
            return np.full(len(name), -1)
        at = self.at[name >> np.uint64(64 - LOOKUP_BITS)]
        return np.where(self.name[at] == name, at, -1)


def score(docs: DataFrame, training: DataFrame | Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row of docs: id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    score is log10 of the model's probability of the whole text (its bytes and its end); a null text is scored
    as an empty one, whose only token is the end. Without training rows the counts are 0 and the model knows
    nothing. training: rows with texts, or a condition that picks those of docs, which are then read once for both.
    Ids may repeat or be null; other columns aren't read.
    """
    spark = docs.sparkSession
    if isinstance(training, Column):
        texts = docs.select(F.col(text_col).alias("t"), F.coalesce(training, F.lit(False)).alias("training"))
    else:
        texts = docs.select(F.col(text_col).alias("t"), F.lit(False).alias("training")).union(training.select(text_col, F.lit(True)))
    tokens = staged(gather_tokens(texts))
    counts = staged(word_counts(tokens.where("n > 0")))
    size = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.max(F.when(F.col("word") == F.lit(b" "), F.col("c"))).alias("ends")).first()
    n, v, ends = size["n"] or 0, size["v"], size["ends"]
    n_tokens = tokens.count()
    parts, buckets = -(-n_tokens // PART) or 1, 4 * (1 + n_tokens * TOKEN_PAIRS // (4 * PAIRS))
    dealt = staged(parts_of(tokens, parts))
    known = dealt.union(staged(answers(dealt.repartition(parts, "part"), buckets)))
    mixer = train(known, n_tokens, buckets)
    costs = staged(token_costs(known, parts, buckets, mixer).join(counts, "word", "left").select("name", "n", "cost", "c", F.col("word").isNotNull().alias("real")))
    # The most frequent tokens needn't be joined. Bounded by FREQUENT.
    top = most_frequent(costs, "n", FREQUENT, "name").select("name", "cost", F.coalesce("c", F.lit(0)).alias("c")).toArrow()
    usual = spark.sparkContext.broadcast(Lookup(*(top.column(i).to_numpy() for i in range(3))))
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    schema = f"row long, name long, `{id_col}` {kind}, n_tokens long, known long, sure double, cost double, n_bytes long"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = usual.value
        end = float(np.log10((ends or 0) + 0.1))
        id_type = pa.null()

        def seen(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal id_type
            for b in batches:
                id_type = b.schema.field(2).type
                yield b

        for rows, cut in cuts(rows_of(seen(with_bytes(batches)))):
            _, number, key = zip(*rows, strict=True)
            at, real = table.find(cut.name), cut.size > 1
            sums = [np.add.reduceat(x, cut.bounds) for x in (real.astype(np.int64), (real & table.counted[at]).astype(np.int64), np.where(real, table.log[at], 0.0), table.cost[at])]
            m, known = sums[0] + 1, sums[1] + (ends is not None)
            number = np.array(number, np.int64)
            rare = np.flatnonzero(at < 0)
            size = len(rows) + len(rare)
            wide = lambda x: pa.concat_arrays([x, pa.nulls(len(rare), x.type)])
            whole = [pa.array(list(key), id_type), pa.array(m), pa.array(known), pa.array(sums[2] + end), pa.array(sums[3]), pa.array([len(r[0] or b"") for r in rows], pa.int64())]
            columns = [pa.array(np.append(number, number[cut.text[rare]])), pa.concat_arrays([pa.nulls(len(rows), pa.int64()), pa.array(cut.name[rare].view(np.int64))]), *map(wide, whole)]
            batch = pa.RecordBatch.from_arrays(columns, ["row", "name", id_col, "n_tokens", "known", "sure", "cost", "n_bytes"])
            for i in range(0, size, 50_000):
                yield batch.slice(i, 50_000)

    numbered = docs.select(F.col(text_col).alias("t"), F.monotonically_increasing_id().alias("row"), F.col(id_col))
    scored = staged(numbered.mapInArrow(lean(run), schema))
    rare = scored.where("name IS NOT NULL").select("row", "name")
    joined = rare.join(costs.select("name", F.col("cost").alias("its"), "c", "real").hint("shuffle_hash"), "name")
    log = F.when(F.col("real"), F.log10(F.coalesce(F.col("c"), F.lit(0)) + F.lit(0.1))).otherwise(F.lit(0.0))
    more = joined.groupBy("row").agg(F.sum(log).alias("more"), F.count(F.when(F.col("real"), F.col("c"))).alias("also"), F.sum("its").alias("its"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    summed = scored.where("name IS NULL").drop("name").join(more, "row", "left").withColumn("score", F.col("cost") + zero("its"))
    return summed.select(
        id_col,
        "n_tokens",
        (F.col("known") + zero("also")).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("sure") + zero("more") - F.col("n_tokens") * F.lit(float(np.log10(n + 0.1 * (v + 1))))).alias("base_score"),
        "score",
        (-F.col("score") * F.lit(float(np.log2(10))) / (F.col("n_bytes") + F.lit(1))).alias("bits_per_byte"),
    )
