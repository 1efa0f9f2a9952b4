"""Removal of repeated byte strings by sorting suffixes.

A byte goes if a WIDTH-byte string that covers it also starts earlier. No machine can sort the suffixes of the
whole corpus, so strings are brought together first, by content alone:

1. In each WIDTH-byte window the GRAM-byte substring with the smallest hash is its anchor. Equal windows have
   equal anchors, and the windows of one anchor form a segment. Anchors' hashes meet in buckets, once per chunk
   of documents; a document is told which of its anchors come again.
2. The segments of those anchors (some 130 bytes each) meet in buckets. Of equal segments in a chunk of
   documents only the first is sent; the others are known to be repeats there and then. An anchor that comes
   very often sends its windows one by one, so that what follows or precedes a common passage doesn't gather
   in one task.
3. In a bucket, an anchor with one distinct segment is settled by its first place. Of an anchor with many, only
   the parts whose windows' hashes come again are kept. The segments of all other anchors are joined to texts
   of bounded size whose suffixes are sorted in two stages: those smaller than their successors directly, the
   rest induced from them by scanning the buckets of first bytes. Adjacent common prefixes of WIDTH bytes then
   name equal windows, and the first place of each stays.
4. Documents take the removed runs and return what is left.
"""

from __future__ import annotations

from collections.abc import Generator, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_bounds, bucketwise, exchanged, lean, mixed, most_frequent, partitions, rows_of, sliced, staged

WIDTH, GRAM = 100, 40
SPAN = WIDTH - GRAM + 1
#: From how many places on an anchor's windows are sent one by one, and of how many such anchors at most (8 bytes each are broadcast).
OFTEN, OFTEN_ANCHORS = 200_000, 500_000
#: Bytes of documents in a chunk, and of segments whose suffixes are sorted together.
CHUNK, SORTED = 3 << 20, 1 << 20
#: Windows whose anchors are sought at once (places among them take 24 bits): few enough that what they need stays in a core's cache.
BLOCK = 1 << 16
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93)]


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hashes of all substrings of `gram` bytes (48 bits)."""
    h = data.astype(np.uint64) + np.uint64(1)
    kept, size, parts = gram, 1, []
    with np.errstate(over="ignore"):
        while True:
            if kept & size:
                parts.append((size, h))
            if size * 2 > kept:
                break
            h = h[:-size] * _ODD[len(bin(size)) % 6] + h[size:]
            size *= 2
        total, at = None, 0
        for size, h in parts:
            part = h[at : at + len(data) - gram + 1]
            total = part if total is None else total * _ODD[5] + part
            at += size
        return mixed(total) >> np.uint64(16)


def leftmost_minima(hashes: np.ndarray) -> np.ndarray:
    """Where in each SPAN hashes the smallest (by 40 of its 48 bits) stands first."""
    low = (hashes >> np.uint64(8) << np.uint64(24)) | np.arange(len(hashes), dtype=np.uint64)
    size = 1
    while size * 2 <= SPAN:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    low = np.minimum(low[: len(low) - (SPAN - size)], low[SPAN - size :])
    return (low & np.uint64((1 << 24) - 1)).astype(np.int64)


def anchors(sizes: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts of these sizes laid end to end: for each anchor its text, place in the text, hash, and the first and last start of its windows."""
    begin = np.cumsum(sizes) - sizes
    end = begin + sizes
    found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for at in range(0, len(data) - WIDTH + 1, BLOCK):
        hashes = gram_hashes(data[at : at + BLOCK + WIDTH - 1])
        place = leftmost_minima(hashes)
        stop = at + len(place)
        texts = np.arange(np.searchsorted(end, at, "right"), np.searchsorted(begin, stop))
        text = np.repeat(texts, np.minimum(end[texts], stop) - np.maximum(begin[texts], at))
        start = np.flatnonzero(np.arange(at + WIDTH, stop + WIDTH) <= end[text])
        if not len(start):
            continue
        text, place = text[start], place[start]
        new = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        last = np.append(new[1:], len(start)) - 1
        found.append((text[new], at + place[new], hashes[place[new]], at + start[new], at + start[last]))
    owner, place, h, first, last = (np.concatenate(x) for x in zip(*found, strict=True))
    # An anchor whose windows lie in two blocks was found in both.
    new = np.append(True, place[1:] != place[:-1])[: len(place)]
    owner, place, h, first, last = owner[new], place[new], h[new], first[new], last[np.append(new[1:], True)[: len(new)]]
    return owner, place - begin[owner], h, first - begin[owner], last - begin[owner]


def suffix_array(data: np.ndarray, depth: int = WIDTH) -> np.ndarray:
    """Starts of the suffixes in order of their first `depth` bytes at least (two-stage sorting)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    kind = place_type(n)
    wide = data.astype(np.int16)
    turn = np.arange(n, dtype=kind)
    turn[:-1][wide[:-1] == wide[1:]] = n
    turn = np.minimum.accumulate(turn[::-1], out=turn[::-1])[::-1]
    smaller = np.append(wide, wide.dtype.type(-1))[turn + 1] > wide[turn]  # than its successor
    del turn
    # Stage one: sort those directly, eight bytes at a time; only what is still tied goes on.
    key = eight_bytes(data)
    order = np.flatnonzero(smaller).astype(kind)
    group = np.zeros(len(order), kind)
    tied = np.arange(len(order), dtype=kind)
    for at in range(0, depth + 8, 8):
        if not len(tied):
            break
        k = key[np.minimum(order[tied] + at, n)].astype(np.uint64)
        by = np.lexsort((k, group[tied]))
        order[tied] = order[tied][by]
        g, k = group[tied], k[by]
        new = np.append(True, (g[1:] != g[:-1]) | (k[1:] != k[:-1]))
        group[tied] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
        alone = new & np.append(new[1:], True)
        tied = tied[~alone]
    # Stage two: bucket by bucket, what precedes a suffix and is larger than it goes to the end of its own bucket.
    first = wide[order]
    cuts = np.searchsorted(first, np.arange(257))
    waiting: dict[int, list[np.ndarray]] = {int(wide[-1]): [np.array([n - 1], kind)]} if not smaller[-1] else {}
    out = []
    for c in range(256):
        found = waiting.pop(c, [])
        wave = np.concatenate(found) if found else np.zeros(0, kind)
        part = [wave]
        while len(wave):
            wave = wave[wave > 0] - 1
            wave = wave[(wide[wave] == c) & ~smaller[wave]]
            part.append(wave)
        part.append(order[cuts[c] : cuts[c + 1]])
        full = np.concatenate(part)
        if not len(full):
            continue
        out.append(full)
        before = full[full > 0] - 1
        before = before[wide[before] > c]
        b = wide[before]
        by = np.argsort(b, kind="stable")
        before, b = before[by], b[by]
        edges = np.flatnonzero(np.append(True, b[1:] != b[:-1])) if len(b) else []
        for lo, hi in zip(edges, [*edges[1:], len(b)], strict=True) if len(b) else ():
            waiting.setdefault(int(b[lo]), []).append(before[lo:hi])
    return np.concatenate(out)


def place_type(n: int) -> type:
    """The narrowest type of places in n bytes, and of those a little beyond."""
    return np.int32 if n < (1 << 31) - 2 * WIDTH else np.int64


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """At each place the next eight bytes as a big-endian number (zeros after the end); one place more than data. A view of a copy of data."""
    return np.ndarray((len(data) + 1,), ">u8", buffer=data.tobytes() + bytes(8), strides=(1,))


def equal_windows(data: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each suffix in order, whether it shares WIDTH bytes with the one before."""
    key, n = eight_bytes(data), len(data)
    same = np.zeros(len(order), bool)
    at = np.arange(1, len(order), dtype=place_type(n))
    for step in [*range(0, WIDTH - 8, 8), WIDTH - 8]:
        a, b = order[at] + step, order[at - 1] + step
        at = at[(key[np.minimum(a, n)] == key[np.minimum(b, n)]) & (np.maximum(a, b) + 8 <= n)]
    same[at] = True
    return same


def _chunks(batches: Iterable[pa.RecordBatch], text_at: int) -> Iterator[tuple[list[tuple], np.ndarray, np.ndarray]]:
    """Rows, sizes of their texts in bytes, and the bytes."""
    rows = ((*r[:text_at], (r[text_at] or "").encode("utf-8", "replace"), *r[text_at + 1 :]) for r in rows_of(batches))
    for held in sliced(rows, lambda r: len(r[text_at]) + 64, CHUNK):
        raw = [r[text_at] for r in held]
        yield held, np.array([len(x) for x in raw], np.int64), np.frombuffer(b"".join(raw), np.uint8)


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, v, t): v tells rows with equal ids and other texts apart; a null id counts as the smallest."""
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(text_col).alias("v"), F.col(text_col).alias("t"))


def _candidates(docs: DataFrame) -> DataFrame:
    """(id, v, places): places of anchors that come more than once, four bytes each; without places, a very common anchor and how often it comes."""
    buckets = 4 * partitions(docs, 0.8, 16 << 20)

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, sizes, data in _chunks(batches, 2):
            owner, place, h, _, _ = anchors(sizes, data)
            if not len(h):
                continue
            order = np.argsort(h, kind="stable")
            h, owner, place = h[order], owner[order], place[order]
            new = np.append(True, h[1:] != h[:-1])
            count = np.diff(np.append(np.flatnonzero(new), len(h)))
            run = np.cumsum(new) - 1
            ids, vs = np.array([r[0] for r in held], np.int64), np.array([r[1] for r in held], np.int64)
            out_bucket, out_kind, out_blob = [], [], []
            # The first of each hash is sent for all; the others are candidates anyway.
            for kind, mask in ((0, new), (1, ~new)):
                if not mask.any():
                    continue
                hh, o, p, c = h[mask], owner[mask], place[mask], count[run[mask]]
                key = hh if kind == 0 else mixed(ids[o].view(np.uint64))
                by, found, bounds = bucket_bounds(key, buckets)
                hh, o, p, c = hh[by], o[by], p[by], c[by]
                for b, lo, hi in zip(found.tolist(), bounds, bounds[1:], strict=False):
                    mine, back = np.unique(o[lo:hi], return_inverse=True)
                    x = hh[lo:hi] if kind == 0 else np.zeros(0, np.uint64)
                    arrays = (ids[mine], vs[mine], back.astype(np.uint16 if len(mine) < 65536 else np.uint32), p[lo:hi].astype(np.uint32), (x >> np.uint64(16)).astype(np.uint32), (x & np.uint64(0xFFFF)).astype(np.uint16), np.minimum(c[lo:hi], 65535).astype(np.uint16) if kind == 0 else np.zeros(0, np.uint16))
                    out_bucket.append(b)
                    out_kind.append(kind)
                    out_blob.append(np.array([len(a) for a in arrays] + [arrays[2].itemsize], np.int64).tobytes() + b"".join(a.tobytes() for a in arrays))
            yield pa.RecordBatch.from_arrays([pa.array(out_bucket, pa.int64()), pa.array(out_kind, pa.int32()), pa.array(out_blob, pa.binary())], ["bucket", "kind", "blob"])

    def opened(blob: bytes) -> list[np.ndarray]:
        *sizes, width = np.frombuffer(blob, np.int64, 8)
        at, out = 64, []
        for size, kind in zip(sizes, (np.int64, np.int64, np.uint16 if width == 2 else np.uint32, np.uint32, np.uint32, np.uint16, np.uint16), strict=True):
            out.append(np.frombuffer(blob, kind, size, at))
            at += int(size) * np.dtype(kind).itemsize
        return out

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in bucketwise(batches):
            ids, vs, places = [], [], []
            parts = []
            for kind, blob in rows:
                i, v, back, p, hi, lo, c = opened(blob)
                if kind:
                    ids.append(i[back])
                    vs.append(v[back])
                    places.append(p)
                else:
                    parts.append((hi.astype(np.uint64) << np.uint64(16) | lo, i[back], v[back], p, c.astype(np.int64)))
            if parts:
                h, i, v, p, c = (np.concatenate(x) for x in zip(*parts, strict=True))
                by = np.argsort(h, kind="stable")
                start = np.flatnonzero(np.append(True, h[by][1:] != h[by][:-1]))
                total = np.repeat(np.add.reduceat(c[by], start), np.diff(np.append(start, len(h))))
                kept = by[total > 1]
                ids.append(i[kept])
                vs.append(v[kept])
                places.append(p[kept])
                often = start[total[start] >= OFTEN]
                if len(often):
                    yield pa.RecordBatch.from_arrays([pa.array(h[by][often].view(np.int64)), pa.array(total[often]), pa.nulls(len(often), pa.binary())], ["id", "v", "places"])
            if not ids:
                continue
            i, v, p = np.concatenate(ids), np.concatenate(vs), np.concatenate(places)
            by = np.lexsort((v, i))
            i, v, p = i[by], v[by], p[by]
            start = np.flatnonzero(np.append(True, (i[1:] != i[:-1]) | (v[1:] != v[:-1]))) if len(i) else np.zeros(0, int)
            blobs = [x.tobytes() for x in np.split(p, start[1:])] if len(i) else []
            yield pa.RecordBatch.from_arrays([pa.array(i[start]), pa.array(v[start]), pa.array(blobs, pa.binary())], ["id", "v", "places"])

    packed = docs.mapInArrow(lean(emit), "bucket long, kind int, blob binary")
    return exchanged(packed, buckets).mapInArrow(lean(meet), "id long, v long, places binary")


def _run_rows(ids: list[int], vs: list[int], first: list[int], last: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vs, pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64())], ["id", "v", "first", "last"])


def repeated_parts(segments: list[tuple[bytes, int, int, int]]) -> list[tuple[bytes, int, int, int]]:
    """The parts of segments (bytes, id, v, start) whose windows may come again: equal ones all stay, others too if 32 bits of their hashes are equal."""
    hashes = []
    for held in sliced(segments, lambda x: len(x[0]), BLOCK):
        sizes = np.array([len(x[0]) for x in held], np.int64)
        h = gram_hashes(np.frombuffer(b"".join(x[0] for x in held), np.uint8), WIDTH)
        whole = np.arange(WIDTH, len(h) + WIDTH) <= np.repeat(np.cumsum(sizes), sizes)[: len(h)]
        hashes.append(h[whole].astype(np.uint32))
    h = np.concatenate(hashes)
    s = np.sort(h)
    twice = np.append(np.unique(s[1:][s[1:] == s[:-1]]), np.uint32(0xFFFFFFFF))  # the last is there for places beyond
    again = np.concatenate([twice[np.searchsorted(twice, x)] == x for x in hashes])
    count = np.array([len(x[0]) - WIDTH + 1 for x in segments], np.int64)
    begin = np.cumsum(count) - count
    edge = np.zeros(len(again) + 1, bool)
    edge[begin] = edge[-1] = True
    first = np.flatnonzero(again & (edge[:-1] | ~np.append(False, again[:-1])))
    last = np.flatnonzero(again & (edge[1:] | ~np.append(again[1:], False)))
    owner = np.searchsorted(begin, first, "right") - 1
    out = []
    for k, a, b in zip(owner.tolist(), (first - begin[owner]).tolist(), (last - begin[owner]).tolist(), strict=True):
        s, i, v, start = segments[k]
        out.append((s[a : b + WIDTH], i, v, start + a))
    return out


def _first_places(segments: list[tuple[bytes, int, int, int]]) -> Generator[tuple[int, int, int, int], None, dict[bytes, tuple[int, int, int]]]:
    """Runs of all but the first of equal segments; returns (id, v, start) of the first of each."""
    firsts: dict[bytes, tuple[int, int, int]] = {}
    for s, i, v, start in segments:
        if s not in firsts or (i, start) < (firsts[s][0], firsts[s][2]):
            firsts[s] = (i, v, start)
    for s, i, v, start in segments:
        if (i, start) != (firsts[s][0], firsts[s][2]):
            yield i, v, start, start + len(s) - WIDTH
    return firsts


def settle(groups: list[list[tuple[bytes, int, int, int]]]) -> Iterator[tuple[int, int, int, int]]:
    """Removed runs of window starts (id, v, first, last) of segments (bytes, id, v, start), grouped by anchor."""
    texts: list[list[tuple[bytes, int, int, int]]] = [[]]
    size = 0
    for group in groups:
        firsts = yield from _first_places(group)
        if sum(map(len, firsts)) > SORTED:
            firsts = yield from _first_places(repeated_parts([(s, *place) for s, place in firsts.items()]))
        if len(firsts) > 1:
            if size > SORTED:
                texts.append([])
                size = 0
            texts[-1] += [(s, *place) for s, place in firsts.items()]
            size += sum(map(len, firsts))
    for held in texts:
        if not held:
            continue
        held.sort(key=lambda x: (x[1], x[3]))
        sizes = np.array([len(x[0]) for x in held], np.int64)
        data = np.frombuffer(b"".join(x[0] for x in held), np.uint8)
        begin = np.cumsum(sizes) - sizes
        order = suffix_array(data)
        kind = place_type(len(data))
        owner = np.repeat(np.arange(len(held), dtype=kind), sizes)
        offset = np.arange(len(data), dtype=kind) - begin.astype(kind)[owner]
        whole = offset + WIDTH <= sizes.astype(kind)[owner]
        order = order[whole[order]]  # only windows inside a segment
        if not len(order):
            continue
        same = equal_windows(data, order)
        cluster = np.cumsum(~same) - 1
        ids, starts = np.array([x[1] for x in held], np.int64), np.array([x[3] for x in held], np.int64)
        at = starts[owner[order]] + offset[order]
        rank = np.lexsort((at, ids[owner[order]], cluster))
        c = cluster[rank]
        lead = np.append(True, c[1:] != c[:-1])
        i, a = ids[owner[order[rank]]], at[rank]
        head = np.maximum.accumulate(np.where(lead, np.arange(len(c)), 0))
        gone = order[rank][(i != i[head]) | (a != a[head])]
        gone.sort()
        if not len(gone):
            continue
        cuts = np.flatnonzero(np.append(True, (np.diff(gone) != 1) | (owner[gone[1:]] != owner[gone[:-1]])))
        ends = np.append(cuts[1:], len(gone)) - 1
        for lo, hi in zip(gone[cuts].tolist(), gone[ends].tolist(), strict=True):
            _, i, v, start = held[owner[lo]]
            yield i, v, int(start + offset[lo]), int(start + offset[hi])


def _removed(docs: DataFrame, found: DataFrame, buckets: int) -> DataFrame:
    """(id, v, first, last): removed runs of window starts."""
    often = most_frequent(found.where("places IS NULL"), "v", OFTEN_ANCHORS, "id").select("id").toArrow()  # bounded by OFTEN_ANCHORS
    common = docs.sparkSession.sparkContext.broadcast(np.sort(often.column(0).to_numpy()))

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, sizes, data in _chunks(batches, 2):
            owner, place, h, first, last = anchors(sizes, data)
            pieces: dict[tuple[int, bytes], list[tuple[int, int, int]]] = {}
            ends = np.searchsorted(owner, np.arange(len(held) + 1))
            for k, (i, v, raw, blobs) in enumerate(held):
                at = np.concatenate([np.frombuffer(b, np.uint32) for b in blobs])
                lo, hi = ends[k], ends[k + 1]
                mine = np.flatnonzero(np.isin(place[lo:hi], at)) + lo
                often = np.isin(h[mine].view(np.int64), common.value)
                for key, a, b, c in zip(h[mine].tolist(), first[mine].tolist(), last[mine].tolist(), often.tolist(), strict=True):
                    if c:
                        for s in range(a, b + 1):
                            w = raw[s : s + WIDTH]
                            pieces.setdefault((xxhash.xxh3_64_intdigest(w), w), []).append((i, s, v))
                    else:
                        pieces.setdefault((key, raw[a : b + WIDTH]), []).append((i, a, v))
            out: dict[int, list[tuple]] = {}
            runs: list[tuple[int, int, int, int]] = []
            for (key, piece), places in pieces.items():
                i, a, v = min(places) if len(places) > 1 else places[0]
                out.setdefault(key % buckets, []).append((key, piece, i, v, a))
                if len(places) > 1:
                    runs += [(j, w, b, b + len(piece) - WIDTH) for j, b, w in places if (j, b) != (i, a)]
            rows = [(b, *packed_segments(x)) for b, x in out.items()]
            runs = merged_runs(runs)
            # Runs known already go along, to the bucket of their document.
            for b, x in _by(runs, lambda r: r[0] % buckets).items():
                rows.append((b, np.array(x, np.int64).tobytes(), None))
            for at in range(0, len(rows), 512):
                b, s, t = zip(*rows[at : at + 512], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(s, pa.binary()), pa.array(t, pa.binary())], ["bucket", "places", "bytes"])

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in bucketwise(batches):
            groups: dict[int, list] = {}
            runs: list[tuple[int, int, int, int]] = []
            for places, data in rows:
                if data is None:
                    runs += map(tuple, np.frombuffer(places, np.int64).reshape(-1, 4).tolist())
                    continue
                for key, piece, i, v, a in unpacked_segments(places, data):
                    groups.setdefault(key, []).append((piece, i, v, a))
            runs = merged_runs(runs + list(settle([g for g in groups.values() if len(g) > 1])))
            if runs:
                yield _run_rows(*map(list, zip(*runs, strict=True)))

    joined = docs.join(found.where("places IS NOT NULL").groupBy("id", "v").agg(F.collect_list("places").alias("blobs")).hint("shuffle_hash"), ["id", "v"])
    return exchanged(joined.select("id", "v", "t", "blobs").mapInArrow(lean(send), "bucket long, places binary, bytes binary"), buckets).mapInArrow(lean(judge), "id long, v long, first long, last long")


def merged_runs(runs: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Runs (id, v, first, last) with those that touch made one."""
    out: list[tuple[int, int, int, int]] = []
    for i, v, a, b in sorted(runs):
        if out and out[-1][:2] == (i, v) and a <= out[-1][3] + 1:
            out[-1] = (i, v, out[-1][2], max(b, out[-1][3]))
        else:
            out.append((i, v, a, b))
    return out


def _by(rows: list[tuple], key) -> dict[int, list[tuple]]:
    out: dict[int, list[tuple]] = {}
    for r in rows:
        out.setdefault(key(r), []).append(r)
    return out


def packed_segments(rows: list[tuple[int, bytes, int, int, int]]) -> tuple[bytes, bytes]:
    numbers = np.array([(np.int64(np.uint64(k).view(np.int64)), i, v, a, len(s)) for k, s, i, v, a in rows], np.int64)
    return np.ascontiguousarray(numbers.T).tobytes(), b"".join(s for _, s, *_ in rows)


def unpacked_segments(numbers: bytes, data: bytes) -> Iterator[tuple[int, bytes, int, int, int]]:
    at = 0
    for k, i, v, a, size in zip(*np.frombuffer(numbers, np.int64).reshape(5, -1).tolist(), strict=True):
        yield k, data[at : at + size], i, v, a
        at += size


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept binary) for every row.

    A byte is removed if a 100-byte string that covers it also starts earlier: in a text with a smaller id, or
    earlier in the same text; strings overlap, lie within one text, and are judged on the input. A null text is
    empty. A null id counts as smaller than all others. Rows that repeat an id are judged side by side: of equal
    strings at the same place of such rows neither is earlier. What is kept may not be valid UTF-8. Other
    columns aren't read.
    """
    rows = _numbered(docs, id_col, text_col)
    found = staged(_candidates(rows))
    n = partitions(docs, 1.5, 24 << 20)
    dealt = rows.repartition(n, "id", "v")
    runs = _removed(dealt, found, 4 * partitions(docs, 1.0, 12 << 20))
    spans = runs.groupBy("id", "v").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    joined = dealt.join(spans.hint("shuffle_hash"), ["id", "v"], "left").select("id", "t", "runs")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in sliced(((i, (t or "").encode("utf-8", "replace"), r) for i, t, r in rows_of(batches)), lambda r: len(r[1]) + 64, CHUNK):
            out = []
            for i, raw, runs in held:
                spans: list[list[int]] = []
                for a, b in sorted((r["first"], r["last"] + WIDTH) for r in runs or ()):
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(b, spans[-1][1])
                    else:
                        spans.append([a, b])
                kept, at = [], 0
                for a, b in spans:
                    kept.append(raw[at:a])
                    at = b
                kept.append(raw[at:])
                out.append((i, len(raw), sum(b - a for a, b in spans), len(spans), b"".join(kept)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["id", "n_bytes", "n_removed", "n_spans", "kept"])

    done = joined.mapInArrow(lean(cut), "id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return done.select(F.nullif("id", F.lit(-(1 << 63))).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept")
