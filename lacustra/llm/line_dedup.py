"""Line dedup: an exact set-similarity join of lines that removes later matches.

A line's set holds its distinct words. A line goes if an earlier line (smaller id, or same text and earlier)
has a Jaccard similarity of percent / 100 or more; all is judged on the input.

1. A scan counts all words in a table of hashed slots, which follows the input up to a bound; its steps of
   rarity are broadcast. Words are ordered by rarity, then by hash.
2. A second scan sends, for each distinct set of a chunk, its class (two hashes) with its place, and its prefix: the
   n - ceil(p n) + 1 rarest words, of which matching sets share one. Words that come COMMON times are listed in pairs,
   from prefixes that are one word longer, so no list belongs to such a word alone. An entry holds a bit map of the
   set (each word flips a bit) instead of the set.
3. Where a class meets, all its lines but the earliest are settled. In a list, each entry meets earlier ones by length,
   position (the word they share as their first) and bit maps; up to TRIES of them, the earliest, become
   candidates. A list in which an entry has more is kept as well.
4. The lines of candidates are fetched, and their words compared. An entry that has more partners and that none of its
   candidates removes is compared with all of its lists, in blocks of at most GROUP lines.

A class needs only its earliest line: whatever matches a later one matches that as well.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_bounds, bucketwise, estimated_bytes, exchanged, lean, mixed, partitions, rows_of, squeezed, staged, texts_of, unsqueezed, word_hashes
from .ngram_join import at_least

#: Slots of the table of word counts: one for so many bytes of input, within these powers of two (a byte each when broadcast).
SLOT_BYTES, SLOT_BITS = 128, (18, 24)
#: Words that come so often (by slots) are listed in pairs only; for lines of LONE words or more, singly.
COMMON, LONE = 20_000, 2_048
#: Bytes of text whose lines are listed together, words of which sets are made at once, and words that are counted at once.
TEXT, WORDS, COUNTED = 3 << 20, 100_000, 2_000_000
#: Lines of so many words or more have bit maps of LONG_BITS words of 64 bits, shorter ones of one; lists are apart. Those
#: that can match lines on the other side as well are listed on both.
LONG, LONG_BITS = 80, 4
#: Candidates that a line gets from a list at once; lists up to so many lines are compared together, in longer ones WINDOW earlier lines at a time.
TRIES, SMALL, WINDOW = 3, 48, 512
#: Lines of a list that meet in one block once candidates have been tried.
GROUP = 1024
_STEPS = 64
_KEY, _HASH = np.uint64(50), np.uint64(44)
_WORD = regex.compile(r"[\p{L}\p{N}]")
_ALNUM = bytes(b < 128 and chr(b).isalnum() for b in range(256))


def lines_of(text: str | None) -> list[str]:
    """The lines of a text; none if it is null or empty."""
    return text.split("\n") if text else []


def line_words(line: str) -> list[bytes]:
    """A line's words (A-Z lower-cased, cut at ASCII white space); none if it has no letter or digit."""
    return line.encode("utf-8", "replace").lower().split() if _WORD.search(line) else []


def steps_of(count: np.ndarray) -> np.ndarray:
    """Steps of rarity of counts: 0 for the rarest, below _STEPS."""
    return np.minimum(_STEPS - 1, np.floor(1.5 * np.log2(np.maximum(count, 1)))).astype(np.uint8)


def rarity(docs: DataFrame) -> np.ndarray:
    """Steps of rarity by slot (the hash's highest bits) from the counts of all words of docs (t)."""
    want = max(1, estimated_bytes(docs) // SLOT_BYTES)
    bits = min(max(SLOT_BITS[0], want.bit_length()), SLOT_BITS[1])
    slices = 1 << max(0, bits - 18)  # of 2**18 slots

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def out() -> pa.RecordBatch:
            slot, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            bounds = np.searchsorted(slot, np.arange(slices + 1) << 18)
            full = [i for i in range(slices) if bounds[i] < bounds[i + 1]]
            packed = [squeezed(slot[bounds[i] : bounds[i + 1]], n[bounds[i] : bounds[i + 1]]) for i in full]
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(packed, pa.binary())], ["bucket", "blob"])

        for data in joined(batches, 0):
            h = word_hashes(data)[1]
            held.append((h >> np.uint64(64 - bits)).astype(np.int32))
            size += len(h)
            if size > COUNTED:
                yield out()
                size = 0
        if size:
            yield out()

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for bucket, blob in rows_of(b.slice(i, 8) for b in batches for i in range(0, b.num_rows, 8)):
            if bucket != now:
                if now is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([steps_of(total).tobytes()], pa.binary())], ["bucket", "blob"])
                now, total = bucket, np.zeros(1 << min(18, bits), np.int64)
            slot, n = unsqueezed(blob)
            total[slot - (bucket << 18)] += n
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([steps_of(total).tobytes()], pa.binary())], ["bucket", "blob"])

    counts = docs.select("t").mapInArrow(lean(count), "bucket long, blob binary")
    steps = np.zeros(1 << bits, np.uint8)
    for bucket, blob in exchanged(counts, 4 * slices).mapInArrow(lean(add), "bucket long, blob binary").collect():  # 2 ** SLOT_BITS[1] bytes at most
        steps[bucket << 18 : (bucket << 18) + len(blob)] = np.frombuffer(blob, np.uint8)
    return steps


def joined(batches: Iterable[pa.RecordBatch], column: int) -> Iterator[bytes]:
    """Texts of a string column, joined by line feeds, about 256 KB at a time."""
    held, size = [], 0
    for batch in batches:
        for t in batch.column(column).cast(pa.binary()).to_pylist():
            if t:
                held.append(t)
                size += len(t)
                if size > 1 << 18:
                    yield b"\n".join(held)
                    held, size = [], 0
    if held:
        yield b"\n".join(held)


class LineSets:
    """Sets of the lines of joined texts, without lines that have no letter or digit.

    line: the number of each set's line; sizes; starts of the sets in keys, which are ordered by rarity; two hashes of each set.
    """

    def __init__(self, data: bytes, steps: np.ndarray, at_once: int = WORDS):
        start, h = word_hashes(data)
        raw = np.frombuffer(data, np.uint8)
        ends = np.append(np.flatnonzero(raw == 10), len(raw))
        bounds = np.concatenate([[0], np.searchsorted(start, ends)])
        words = np.diff(bounds)
        words[~with_letters(data, ends, words > 0)] = 0
        kept = np.repeat(words > 0, np.diff(bounds))
        h, lines = h[kept], np.flatnonzero(words)
        words = words[lines]
        shift = np.uint64(64 - (len(steps).bit_length() - 1))
        key = steps[(h >> shift).astype(np.int64)].astype(np.uint64) << _HASH | h >> np.uint64(20)
        parts, sizes, at = [], [], 0
        cuts = np.cumsum(words)
        i = 0
        while i < len(words):
            j = min(max(i + 1, int(np.searchsorted(cuts, at + at_once, "right"))), i + 8192)
            part = np.sort(np.repeat(np.arange(j - i, dtype=np.uint64), words[i:j]) << _KEY | key[at : cuts[j - 1]])
            part = part[np.append(True, part[1:] != part[:-1])]
            sizes.append(np.bincount((part >> _KEY).astype(np.int64), minlength=j - i))
            parts.append(part & np.uint64((1 << 50) - 1))
            at, i = int(cuts[j - 1]), j
        self.line = lines
        self.keys = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        self.sizes = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        with np.errstate(over="ignore"):
            self.flips = mixed(self.keys)
            other = mixed(self.keys ^ np.uint64(0x5851F42D4C957F2D))
            self.hashes = [np.add.reduceat(x, self.starts) if len(x) else x for x in (self.flips, other)]

    def bits(self, chosen: np.ndarray, words: int) -> np.ndarray:
        """Bit maps (chosen x words) of some sets: each key flips one bit."""
        n = self.sizes[chosen]
        starts = np.cumsum(n) - n
        flips = self.flips[np.repeat(self.starts[chosen] - starts, n) + np.arange(n.sum())]
        place = flips >> np.uint64(58 - (words.bit_length() - 1))
        one = np.uint64(1) << (place & np.uint64(63))
        if words == 1:
            return np.bitwise_xor.reduceat(one, starts)[:, None]
        word = place >> np.uint64(6)
        return np.stack([np.bitwise_xor.reduceat(np.where(word == w, one, np.uint64(0)), starts) for w in range(words)], 1)


def with_letters(data: bytes, ends: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Which lines (by their ends) have a letter or digit; only lines that are asked for are looked at beyond ASCII."""
    before = np.append(0, ends[:-1] + 1)
    found = np.logical_or.reduceat(np.frombuffer(data.translate(_ALNUM) + b"\0", np.bool_), before)
    for i in np.flatnonzero(asked & ~found):
        found[i] = _WORD.search(data[before[i] : ends[i]].decode("utf-8", "replace")) is not None
    return found


def listed(sets: LineSets, chosen: np.ndarray, percent: int, common: np.uint64, lone: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What these sets are listed under: tokens, the set of each, and the place of the (first) word in the order.

    Sets that only an equal one can match aren't listed.
    """
    n = sets.sizes[chosen]
    least = at_least(n, percent)
    prefix = np.where((n * 100 // percent == n) & (least == n), 0, n - least + 1)
    longer = np.where(prefix > 0, np.minimum(n, prefix + 1), 0)  # with the second word of a pair
    of = np.repeat(np.arange(len(n)), longer)
    place = np.arange(len(of)) - np.repeat(np.cumsum(longer) - longer, longer)
    key = sets.keys[np.repeat(sets.starts[chosen], longer) + place]
    usual = (key >= common) & (n[of] < lone * 100 // percent + 1)  # as those of `lone` words may match them
    alone = (~(key >= common) | (n[of] >= lone)) & (place < prefix[of])
    tokens, owners, places = [mixed(key[alone])], [of[alone]], [place[alone]]
    key, of, place = key[usual], of[usual], place[usual]
    start = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
    count = np.diff(np.append(start, len(of)))
    for k in np.unique(count[count > 1]).tolist():
        a, b = np.triu_indices(k, 1)
        step = max(1, 500_000 // len(a))
        for at in range(0, int((count == k).sum()), step):
            rows = start[count == k][at : at + step, None]
            first = place[rows + a] < prefix[of[rows]]
            with np.errstate(over="ignore"):
                tokens.append(mixed(mixed(key[rows + a]) * np.uint64(0x9E3779B97F4A7C15) + key[rows + b])[first])
            owners.append(np.broadcast_to(of[rows], first.shape)[first])
            places.append(place[rows + a][first])
    return np.concatenate(tokens), chosen[np.concatenate(owners)], np.concatenate(places)


def candidates(token: np.ndarray, bits: np.ndarray, n: np.ndarray, at: np.ndarray, percent: int, most: int, small: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows sorted by token and then by place in the input: (row, earlier row) that may match, the `most` earliest for each row of a list, and which rows have more."""
    start = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    count = np.diff(np.append(start, len(token)))
    columns = [np.ascontiguousarray(x) for x in bits.T]
    first_n, second_n = 100 - percent, 100 + percent

    def fits(x, y) -> np.ndarray:
        """Of rows (or slices) x and y in a list: which may match, by bit maps, lengths and places."""
        both = n[x] + n[y]
        apart = sum(np.bitwise_count(b[x] ^ b[y]).astype(np.int64) for b in columns)
        can = apart * second_n <= first_n * both  # matching sets differ in (1 - p) / (1 + p) of both sizes at most
        return can & (np.minimum(n[x] - at[x], n[y] - at[y]) * second_n >= percent * both)

    found_row, found_host = [], []
    more = np.zeros(len(token), bool)
    short = np.repeat(count <= small, count)
    for d in range(1, int(count[count <= small].max(initial=1))):
        same = short[d:] & (token[d:] == token[:-d])
        if not same.any():
            break
        row = np.flatnonzero(same)
        if 4 * len(row) > len(same):
            ok = np.flatnonzero(same & fits(slice(d, None), slice(None, -d)))
        else:
            ok = row[fits(row + d, row)]
        found_row.append(ok + d)
        found_host.append(ok)
    if found_row:
        row, host = np.concatenate(found_row), np.concatenate(found_host)
        order = np.lexsort((host, row))
        row, host = row[order], host[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        more[row[nth >= most]] = True
        found_row, found_host = [row[nth < most]], [host[nth < most]]
    for s, m in zip(start[count > small].tolist(), count[count > small].tolist(), strict=True):
        tries = np.zeros(m, np.int64)
        for lo in range(0, m - 1, window):
            hi = min(m, lo + window)
            asks = np.flatnonzero(tries[lo + 1 :] <= most) + lo + 1
            if not len(asks):
                break
            hosts = np.arange(lo, hi)
            for part in np.array_split(asks, max(1, len(asks) * len(hosts) // 500_000)):
                ok = fits(s + part[:, None], s + hosts[None, :]) & (hosts[None, :] < part[:, None])
                nth = np.cumsum(ok, 1) + tries[part, None]
                x, y = np.nonzero(ok & (nth <= most))
                found_row.append(s + part[x])
                found_host.append(s + hosts[y])
                tries[part] = nth[:, -1]
        more[s + np.flatnonzero(tries > most)] = True
    if not found_row:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), more
    return np.concatenate(found_row), np.concatenate(found_host), more


#: What comes out of the exchange: candidates (class, earlier class, 1 if there are more); lines that go (k, line); members of lists in which a class has
#: more (list, class); the first lines of classes (both hashes, id, k, line).
CANDIDATE, GONE, MEMBER, FIRST = range(4)
FOUND = "kind int, a long, b long, c long, d long, e long"
_FOUND = pa.schema([("kind", pa.int32()), *((x, pa.int64()) for x in "abcde")])


def found_rows(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
    size = len(columns[0])
    given = [pa.array(np.ascontiguousarray(x).view(np.int64)) for x in columns]
    return pa.RecordBatch.from_arrays([pa.array(np.full(size, kind, np.int32)), *given, *(pa.nulls(size, pa.int64()) for _ in range(5 - len(given)))], schema=_FOUND)


def met(docs: DataFrame, percent: int) -> DataFrame:
    """Rows of FOUND from docs (id, t, k); k: a hash of id and text."""
    steps = rarity(docs)
    common = np.uint64(int(steps_of(np.array([COMMON]))[0]) if COMMON else 0) << _HASH
    shared = docs.sparkSession.sparkContext.broadcast(steps)
    buckets = 4 * partitions(docs, 1.2, 12 << 20)

    def posted(sets: LineSets, chosen: np.ndarray, place: np.ndarray, words: int) -> list[tuple[int, int, bytes]]:
        """Packed lists of these sets by bucket, with bit maps of so many words, which is their kind."""
        if not len(chosen):
            return []
        token, of, at = listed(sets, chosen, percent, common, LONE)
        if words > 1:
            token = mixed(token)
        order, found, bounds = bucket_bounds(token, buckets)
        token, of, at = token[order] >> np.uint64(32), of[order], at[order]
        back = np.zeros(len(sets.sizes), np.int64)
        back[chosen] = np.arange(len(chosen))
        bits = sets.bits(chosen, words)[back[of]]
        columns = (token, sets.hashes[0][of], place[of, 0], place[of, 2], sets.sizes[of], at)
        return [(b, words, squeezed(*(x[lo:hi] for x in columns), *(np.ascontiguousarray(x) for x in bits[lo:hi].T))) for b, lo, hi in zip(found.tolist(), bounds, bounds[1:], strict=False)]

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in texts_of((b.set_column(1, "t", b.column(1).cast(pa.binary())) for b in batches), TEXT):
            held = [(i, t, k) for i, t, k in held if t]
            if not held:
                continue
            sets = LineSets(b"\n".join(t for _, t, _ in held), shared.value, WORDS)
            if not len(sets.line):
                continue
            lines = np.array([t.count(b"\n") + 1 for _, t, _ in held])
            first = np.cumsum(lines) - lines
            doc = np.searchsorted(first, sets.line, "right") - 1
            ids = np.array([(i, k) for i, _, k in held], np.int64)
            place = np.column_stack([ids[doc], sets.line - first[doc]])  # id, k, line
            order = np.lexsort((place[:, 1], place[:, 2], place[:, 0], *sets.hashes))
            new = np.append(True, (sets.hashes[0][order][1:] != sets.hashes[0][order][:-1]) | (sets.hashes[1][order][1:] != sets.hashes[1][order][:-1]))
            head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
            # Ties (of rows that repeat an id) are sent like the head.
            tie = (place[order, 0] == place[head, 0]) & (place[order, 2] == place[head, 2])
            again = np.append(False, (np.diff(place[order], axis=0) == 0).all(1)) & ~new
            later, firsts, chosen = order[~tie], order[tie & ~again], order[new]
            n = sets.sizes[chosen]
            rows = posted(sets, chosen[n < LONG], place, 1) + posted(sets, chosen[n >= at_least(LONG, percent)], place, LONG_BITS)
            for kind, some, key in ((-FIRST, firsts, sets.hashes[0]), (-GONE, later, place[:, 1].view(np.uint64))):
                by, found, bounds = bucket_bounds(mixed(key[some]), buckets)
                columns = (*(x[some[by]] for x in sets.hashes), *place[some[by]].T) if kind == -FIRST else (place[some[by], 1], place[some[by], 2])
                rows += [(b, kind, squeezed(*(np.ascontiguousarray(x[lo:hi]) for x in columns))) for b, lo, hi in zip(found.tolist(), bounds, bounds[1:], strict=False)]
            b, kind, x = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(kind, pa.int32()), pa.array(x, pa.binary())], ["bucket", "kind", "blob"])

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in bucketwise(batches):
            by_kind: dict[int, list] = {}
            for kind, blob in rows:
                by_kind.setdefault(kind, []).append(unsqueezed(blob))
            for kind, parts in by_kind.items():
                columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
                if kind == -GONE:
                    yield found_rows(GONE, *columns)
                elif kind == -FIRST:
                    yield from earliest(*columns)
                else:
                    yield from narrowed(bucket, kind, *columns)

    def earliest(a, b, i, k, line) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((line, i, b, a))
        a, b, i, k, line = (x[order] for x in (a, b, i, k, line))
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
        head = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
        tie = (i == i[head]) & (line == line[head])
        yield found_rows(GONE, k[~tie], line[~tie])
        yield found_rows(FIRST, a[tie], b[tie], i[tie], k[tie], line[tie])

    def narrowed(bucket: int, kind: int, token, name, i, line, n, at, *bits) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((name, line, i, token))
        same = token[order][1:] == token[order][:-1]
        order = order[np.append(same, False) | np.append(False, same)]
        if not len(order):
            return
        # Of a class, the earliest entry stays.
        by = np.lexsort((np.arange(len(order)), name[order], token[order]))
        fresh = np.append(True, (np.diff(name[order][by]) != 0) | (np.diff(token[order][by]) != 0))
        order = order[np.sort(by[fresh])]
        token, name, n, at = token[order], name[order], n[order], at[order]
        bits = np.column_stack([x[order] for x in bits]).view(np.uint64)
        row, host, more = candidates(token, bits, n, at, percent, TRIES, SMALL, WINDOW)
        if len(row):
            yield found_rows(CANDIDATE, name[row], name[host], more[row].astype(np.int64))
        if more.any():
            kept = np.isin(token, token[more])
            with np.errstate(over="ignore"):
                whole = mixed(token[kept].astype(np.uint64) * np.uint64(LONG_BITS + 1) + np.uint64(kind) + (np.uint64(bucket) << np.uint64(36)))
            yield found_rows(MEMBER, whole, name[kept], more[kept].astype(np.int64))

    packed = docs.select("id", "t", "k").mapInArrow(lean(emit), "bucket long, kind int, blob binary")
    return exchanged(packed, buckets).mapInArrow(lean(meet), FOUND)


def matches(x: set[bytes], y: set[bytes], percent: int) -> bool:
    """Whether two sets have a Jaccard similarity of percent / 100 or more."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    shared = len(x & y)
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def rows_out(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)] if rows else [pa.nulls(0, t) for t in schema.types], schema=schema)


def fetched(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(a, b, id, line, k, words) for wanted (a, b, id, k, line) lines of rows (id, t, k)."""
    per_doc = wanted.groupBy("k").agg(F.collect_list(F.struct("a", "b", "id", "line")).alias("asked"))  # at most the lines of one text

    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("id", pa.int64()), ("line", pa.int64()), ("k", pa.int64()), ("words", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        seen: set[int] = set()
        for k, text, asked in rows_of(batches):
            if k in seen:  # a repeated row
                continue
            seen.add(k)
            lines = lines_of(text)
            out += [(x["a"], x["b"], x["id"], x["line"], k, lines[x["line"]]) for x in asked]
            if len(out) > 2048:
                yield rows_out(out, schema)
                out = []
        yield rows_out(out, schema)

    found = rows.select("k", "t").join(per_doc.hint("shuffle_hash"), "k").select("k", "t", "asked")
    return found.mapInArrow(lean(run), "a long, b long, id long, line long, k long, words string")


def verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(k, line) of the later lines of pairs (a, earlier) of classes that match."""
    x = texts.select("a", *(F.col(c).alias(f"x_{c}") for c in ("id", "line", "k", "words")))
    y = texts.select(F.col("a").alias("earlier"), *(F.col(c).alias(f"y_{c}") for c in ("id", "line", "k", "words")))
    both = pairs.join(x, "a").join(y, "earlier")
    schema = pa.schema([("k", pa.int64()), ("line", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for xi, xl, xk, xw, yi, yl, yk, yw in rows_of([batch]):
                if (xi, xl) != (yi, yl) and matches(set(line_words(xw)), set(line_words(yw)), percent):
                    out.append((xk, xl) if (xi, xl) > (yi, yl) else (yk, yl))
            yield rows_out(out, schema)

    columns = [f"{s}_{c}" for s in "xy" for c in ("id", "line", "k", "words")]
    return both.select(*columns).mapInArrow(lean(run), "k long, line long")


def visited(members: DataFrame, texts: DataFrame, open_: DataFrame, percent: int, parts: int) -> DataFrame:
    """(k, line) of lines that match an earlier one, for the open classes (a) of lists (group, a, asks); each meets its whole lists, block by block."""
    asks = members.where("asks = 1").join(open_, "a", "left_semi").select("group", "a")
    sizes = members.join(asks.select("group").distinct(), "group", "left_semi").groupBy("group").agg(F.count("*").alias("m"))
    blocks = F.ceil(F.col("m") / F.lit(GROUP)).cast("long")
    hosts = members.join(sizes, "group").select("group", "a", F.pmod(F.xxhash64("a"), blocks).alias("block"), F.lit(False).alias("asks"))
    guests = asks.join(sizes, "group").select("group", "a", F.explode(F.sequence(F.lit(0).cast("long"), blocks - F.lit(1))).alias("block"), F.lit(True).alias("asks"))
    rows = hosts.union(guests).join(texts, "a").select("group", "block", "asks", "id", "line", "k", "words")
    schema = pa.schema([("k", pa.int64()), ("line", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[tuple]) -> pa.RecordBatch:
            own = [(i, line, set(line_words(w))) for asks, i, line, _, w in held if not asks]
            gone = [(k, line) for asks, i, line, k, w in held if asks and (s := set(line_words(w))) is not None and any((hi, hl) < (i, line) and matches(s, hs, percent) for hi, hl, hs in own)]
            return rows_out(gone, schema)

        now, held = None, []
        for group, block, *rest in rows_of(b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            if held and now != (group, block):
                yield out(held)
                held = []
            now = (group, block)
            held.append(tuple(rest))
        if held:
            yield out(held)

    return rows.repartition(parts, "group", "block").sortWithinPartitions("group", "block", "asks").mapInArrow(lean(run), "k long, line long")


def removed_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(k, line) of the lines of docs (id, t, k) that an earlier line matches."""
    found = staged(met(docs, percent))
    gone = found.where(F.col("kind") == GONE).select(F.col("a").alias("k"), F.col("b").alias("line"))
    pairs = found.where(F.col("kind") == CANDIDATE).groupBy("a", F.col("b").alias("earlier")).agg(F.max("c").alias("more"))
    pairs = staged(pairs)
    members = found.where(F.col("kind") == MEMBER).select(F.col("a").alias("group"), F.col("b").alias("a"), F.col("c").alias("asks"))
    first = found.where(F.col("kind") == FIRST).select("a", "b", F.col("c").alias("id"), F.col("d").alias("k"), F.col("e").alias("line"))
    asked = pairs.select("a").union(pairs.select("earlier")).union(members.select("a")).distinct()
    texts = staged(fetched(docs, first.join(asked, "a", "left_semi")))
    met_once = staged(verified(pairs.select("a", "earlier"), texts, percent).distinct())
    gone = gone.union(met_once)
    open_ = pairs.where("more = 1").select("a").distinct()
    if not open_.isEmpty():
        open_ = texts.join(open_, "a", "left_semi").join(met_once, ["k", "line"], "left_anti").select("a").distinct()
        gone = gone.union(visited(members, texts, staged(open_), percent, partitions(docs, 0.5)))
    return gone.distinct()


def deduplicated(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, n_lines, n_removed, kept, rest) for every row: its text without the lines that an earlier line matches.

    Null and empty texts have no lines and are kept as they are. Lines without a letter or digit never match.
    Kept lines are joined by line feeds. A null id counts as smaller than all others; of rows that repeat an id,
    lines in the same place are not earlier than one another. Of other columns, those named in carry come along
    in the struct `rest`. percent: over 50, so that matching lines that aren't equal share two words or more;
    others raise ValueError.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent must be over 50 and at most 100")
    rest = F.struct(*[F.col(c) for c in carry]) if carry else F.struct(F.lit(0).alias("none"))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(key.alias("id"), F.col(text_col).alias("t"), F.xxhash64(key, F.col(text_col)).alias("k"), rest.alias("rest"))
    gone = removed_lines(rows.drop("rest"), percent).groupBy("k").agg(F.collect_list("line").alias("lines"))  # at most the lines of one text

    def mask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, n = [], []
            for lines in batch.column(1).to_pylist():
                x = np.ones(max(lines) + 1, np.uint8)
                x[lines] = 0
                out.append(x.tobytes())
                n.append(len(lines))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), pa.array(n, pa.int64())], ["k", "stays", "n"])

    # A byte for each line up to the last that goes; 0 for those that go.
    marked = rows.join(gone.mapInArrow(mask, "k long, stays binary, n long").hint("shuffle_hash"), "k", "left")
    lines = F.split("t", "\n", -1)
    stays: Callable = lambda _, i: F.coalesce(F.substring(F.col("stays"), i + F.lit(1), F.lit(1)) != F.lit(b"\0"), F.lit(True))
    left = F.filter(lines, stays)
    n_lines = F.when(F.octet_length("t") > 0, F.size(lines)).otherwise(F.lit(0)).cast("long")
    return marked.select(
        F.nullif("id", F.lit(-(1 << 63))).alias(id_col),
        n_lines.alias("n_lines"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("stays").isNull(), F.col("t")).otherwise(F.array_join(left, "\n")).alias("kept"),
        "rest",
    )
