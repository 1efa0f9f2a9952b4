"""Exact n-gram Jaccard join of documents, and the components of its links.

A document's set holds the 64-bit hashes of its word shingles. Sets link when their Jaccard similarity reaches
a percentage. Nothing is approximate but the hashing (two of a pair's shingles collide once in 2**64).

1. One scan gives each set's size and digest (equal sets become one class) and the shingles that come often
   within a task. The most frequent ones, at most HOT of them, are broadcast and go last in the order of
   shingles. Any fixed order gives the same result; this one keeps common passages out of the prefixes.
2. A second scan emits prefixes. Linked sets x, y share at least l(x) shingles of their prefixes of length
   n - ceil(p n) + l(n), with l a tenth of the size. The index lists of the prefix shingles are cut into
   blocks of sizes and positions that can link, and whole blocks with one set are skipped. A set stays only if l(x) of its
   prefix shingles stand in a block with another set. Those of a block share a group, named by its smallest id.
   For hot shingles the group is known from the first scan, so their lists are never gathered at all.
3. The sets of a group are joined in blocks: the answers of each set are derived from those of a similar set
   before it, so near copies cost only their differences. A block gives one link for each set, not all pairs. Groups of more than GROUP sets are dealt over tasks; blocks are joined with each other
   only where that can still connect something.
4. Links and classes give components by alternating stars.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_bounds, bucketwise, components, exchanged, lean, mixed, most_frequent, partitions, rows_of, staged, texts_of, word_hashes

#: Shingles that are broadcast with the id of their group; 16 bytes each.
HOT = 200_000
#: Sets of a group that one task joins.
GROUP = 1024
#: Prefixes are longer by this part of a set than one shared shingle needs.
EXTEND = 10
#: Hashes that a task holds before it looks for repeated ones, and prefix entries before it sends them.
HELD, SENT = 1_500_000, 1_000_000
_TURN = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of a text (A-Z lower-cased, words cut at ASCII white space).

    With fewer than n words the whole sequence is the one shingle; without words the set is empty.
    """
    h = word_hashes((text or "").encode("utf-8", "replace"))[1]
    if not len(h):
        return h
    with np.errstate(over="ignore"):
        if len(h) < n:
            total = np.uint64(len(h))
            for x in h:
                total = mixed(np.array([total * _TURN[0] + x]))[0]
            return np.array([total])
        total = h[: len(h) - n + 1] * _TURN[0]
        for i in range(1, n):
            total = total + h[i : len(h) - n + 1 + i] * _TURN[i % len(_TURN)] * np.uint64(2 * (i // len(_TURN)) + 1)
        total = np.sort(mixed(total))
        return total[np.append(True, total[1:] != total[:-1])]


def at_least(n, percent: int):
    """ceil(percent * n / 100) for an int or an array."""
    return -(-percent * n // 100)


def extension(n, percent: int):
    """By how much a prefix is longer than one shared shingle needs: what its partners share at least, and what it asks itself."""
    longer = np.maximum(1, n // EXTEND)
    asked = np.maximum(1, at_least(n, percent) // EXTEND)
    return longer, asked


def size_class(n: np.ndarray, percent: int) -> np.ndarray:
    """Sets that can link are in the same class or in neighbouring ones."""
    return np.floor(np.log(np.maximum(n, 1)) / (np.log(100 / percent) * (1 + 1e-9))).astype(np.int64)


def position_blocks(token: np.ndarray, grade: np.ndarray, place: np.ndarray, size: np.ndarray, percent: int) -> np.ndarray:
    """Where blocks begin in rows sorted by list (token), class of sizes and position.

    Of two linked sets, what stands before a shared shingle in one and behind it in the other is lost to both, so its
    positions differ by (1 - p) of the larger set at most. A block ends where the next position is farther away than that,
    for the largest set of the list's class; no set of one block can link with one of another by this list.
    """
    new = np.append(True, (token[1:] != token[:-1]) | (grade[1:] != grade[:-1]))
    start = np.flatnonzero(new)
    largest = np.repeat(np.maximum.reduceat(size, start), np.diff(np.append(start, len(size))))
    return new | (100 * np.diff(place, prepend=place[:1]) > (100 - percent) * largest)


def _blob(*arrays: np.ndarray) -> bytes:
    return np.array([len(a) for a in arrays], np.int64).tobytes() + b"".join(a.tobytes() for a in arrays)


def _arrays(blob: bytes, *kinds: type) -> list[np.ndarray]:
    at, out = 8 * len(kinds), []
    for size, kind in zip(np.frombuffer(blob, np.int64, len(kinds)), kinds, strict=True):
        out.append(np.frombuffer(blob, kind, size, at))
        at += int(size) * np.dtype(kind).itemsize
    return out


def profiles(docs: DataFrame, n: int) -> DataFrame:
    """(kind 0, id, size, digest) for each document, and (kind 1, shingle, how often, smallest id) for shingles that at least four sets of a task hold."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("kind", pa.int32()), ("id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("ref", pa.int64())])
        seen: set[bytes] = set()
        hashes, ids, total = [], [], 0

        def repeated() -> pa.RecordBatch:
            nonlocal total
            h, d = np.concatenate(hashes), np.concatenate(ids)
            order = np.argsort(h, kind="stable")
            h, d = h[order], d[order]
            start = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            count = np.diff(np.append(start, len(h)))
            least = np.minimum.reduceat(d, start)
            often = count >= 4
            k = int(often.sum())
            hashes.clear()
            ids.clear()
            seen.clear()
            total = 0
            return pa.RecordBatch.from_arrays([pa.array(np.ones(k, np.int32)), pa.array(h[start][often].view(np.int64)), pa.array(count[often]), pa.nulls(k, pa.binary()), pa.array(least[often])], schema=schema)

        for held in texts_of(batches):
            out = []
            for key, text in held:
                s = shingle_set(text, n)
                digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None
                out.append((0, key, len(s), digest, None))
                if key is not None and digest is not None and digest not in seen:
                    seen.add(digest)
                    hashes.append(s)
                    ids.append(np.full(len(s), key, np.int64))
                    total += len(s)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
            if total > HELD:
                yield repeated()
        if total:
            yield repeated()

    return docs.mapInArrow(lean(run), "kind int, id long, n long, digest binary, ref long")


def _memberships(docs: DataFrame, n: int, percent: int, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(group, id, n, hits): groups that a set shares with another; the hits of an id sum up to its shared prefix shingles."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)
    buckets = 4 * partitions(docs, 0.6, 16 << 20)

    def prefixes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        hot_keys, hot_refs = shared.value
        ids, sizes, parts, total = [], [], [], 0

        def sent() -> pa.RecordBatch:
            nonlocal total
            out_bucket, out_kind, out_blob = [], [], []
            doc_ids, doc_sizes = np.array(ids, np.int64), np.array(sizes, np.uint32)
            of = np.repeat(np.arange(len(parts), dtype=np.uint32), [len(p) for p in parts])
            tokens = np.concatenate(parts)
            place = np.concatenate([np.arange(len(p), dtype=np.uint32) for p in parts])
            at = np.searchsorted(hot_keys, tokens)
            is_hot = (hot_keys[np.minimum(at, len(hot_keys) - 1)] == tokens) if len(hot_keys) else np.zeros(len(tokens), bool)
            kept = ~is_hot
            jobs = [(0, tokens[kept], of[kept], place[kept], tokens[kept])]
            if is_hot.any():
                owners = of[is_hot]
                jobs.append((1, hot_refs[at[is_hot]].view(np.uint64), owners, place[is_hot], mixed(doc_ids[owners].view(np.uint64))))
            for kind, values, owner, where, key in jobs:
                order, found, bounds = bucket_bounds(key, buckets)
                values, owner, where = values[order], owner[order], where[order]
                for b, lo, hi in zip(found.tolist(), bounds, bounds[1:], strict=False):
                    mine, back = np.unique(owner[lo:hi], return_inverse=True)
                    out_bucket.append(b)
                    out_kind.append(kind)
                    out_blob.append(_blob(doc_ids[mine], doc_sizes[mine], values[lo:hi], back.astype(np.uint32), where[lo:hi]))
            ids.clear()
            sizes.clear()
            parts.clear()
            seen.clear()
            total = 0
            return pa.RecordBatch.from_arrays([pa.array(out_bucket, pa.int64()), pa.array(out_kind, pa.int32()), pa.array(out_blob, pa.binary())], ["bucket", "kind", "blob"])

        for held in texts_of(batches):
            for key, text in held:
                s = shingle_set(text, n)
                if key is None or not len(s) or (digest := hashlib.blake2b(s.tobytes(), digest_size=16).digest()) in seen:
                    continue
                seen.add(digest)
                most = len(s) - at_least(len(s), percent) + int(extension(len(s), percent)[0])
                if len(hot_keys):
                    at = np.minimum(np.searchsorted(hot_keys, s), len(hot_keys) - 1)
                    is_hot = hot_keys[at] == s
                    s = np.concatenate([s[~is_hot], s[is_hot]])
                ids.append(key)
                sizes.append(len(s))
                parts.append(s[:most])
                total += min(most, len(s))
                if total > SENT:
                    yield sent()
        if total:
            yield sent()

    def met(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("group", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("hits", pa.int64())])
        for _, rows in bucketwise(batches):
            by: dict[int, list] = {0: [], 1: []}
            for kind, blob in rows:
                d, size, v, back, where = _arrays(blob, np.int64, np.uint32, np.uint64, np.uint32, np.uint32)
                by[kind].append((v, d[back], size[back].astype(np.int64), where.astype(np.int64)))
            for kind, held in by.items():
                if not held:
                    continue
                token, doc, size, place = (np.concatenate(x) for x in zip(*held, strict=True))
                if kind == 0:  # lists with one entry lead to nothing
                    order = np.argsort(token, kind="stable")
                    token, doc, size, place = token[order], doc[order], size[order], place[order]
                    same = token[1:] == token[:-1]
                    more = np.append(same, False) | np.append(False, same)
                    token, doc, size, place = token[more], doc[more], size[more], place[more]
                if not len(token):
                    continue
                grade = size_class(size, percent)
                token, doc, size, place = np.tile(token, 2), np.tile(doc, 2), np.tile(size, 2), np.tile(place, 2)
                grade = np.append(grade, grade + 1)
                if kind == 0:
                    order = np.lexsort((doc, place, grade, token))
                    token, doc, size, place, grade = (x[order] for x in (token, doc, size, place, grade))
                    new = position_blocks(token, grade, place, size, percent)
                    start = np.flatnonzero(new)
                    count = np.diff(np.append(start, len(doc)))
                    least, most = np.minimum.reduceat(doc, start), np.maximum.reduceat(doc, start)
                    several = np.repeat(least != most, count)
                    group = np.repeat(least, count)[several]
                    token, doc, size = token[several], doc[several], size[several]
                    pairs = np.lexsort((token, doc))
                    fresh = np.append(True, (doc[pairs][1:] != doc[pairs][:-1]) | (token[pairs][1:] != token[pairs][:-1])) if len(doc) else np.zeros(0, bool)
                    once = doc[pairs][fresh]
                else:
                    group = mixed(token * np.uint64(64) + grade.astype(np.uint64)).view(np.int64)
                    once = doc[: len(doc) // 2]
                if not len(doc):
                    continue
                pairs = np.unique(np.stack([doc, group, size]), axis=1)
                docs_found, hits = np.unique(once, return_counts=True)
                first = np.append(True, pairs[0, 1:] != pairs[0, :-1])
                count = np.zeros(pairs.shape[1], np.int64)
                count[first] = hits[np.searchsorted(docs_found, pairs[0, first])]
                yield pa.RecordBatch.from_arrays([pa.array(pairs[1]), pa.array(pairs[0]), pa.array(pairs[2]), pa.array(count)], schema=schema)

    packed = docs.mapInArrow(lean(prefixes), "bucket long, kind int, blob binary")
    return exchanged(packed, buckets).mapInArrow(lean(met), "group long, id long, n long, hits long")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two sets share.

    Sets are taken in the order of their smallest elements, so that similar ones follow one another. The answers of a
    set, its overlaps with all sets, are those of the set before, plus the lists of the elements that it has gained and
    minus the lists of those that it has lost; it is counted anew only where that would touch more lists.
    """
    m = len(sets)
    out = np.zeros((m, m), np.int32)
    size = np.array([len(s) for s in sets])
    token = np.concatenate(sets)
    owner = np.repeat(np.arange(m), size)
    by = np.argsort(token, kind="stable")
    new = np.append(True, token[by][1:] != token[by][:-1]) if len(token) else np.zeros(0, bool)
    start = np.append(np.flatnonzero(new), len(token))
    number = np.empty(len(token), np.int64)
    number[by] = np.cumsum(new) - 1
    holders, begins = owner[by], np.cumsum(size) - size
    held = np.zeros(len(start) - 1, bool)

    def counted(elements: np.ndarray) -> np.ndarray:
        """How many of these elements each set holds."""
        count = start[elements + 1] - start[elements]
        places = np.repeat(start[elements] - np.cumsum(count) + count, count) + np.arange(count.sum())
        return np.bincount(holders[places], minlength=m)

    first = [number[b : b + 3].tolist() if n >= 3 else number[b : b + n].tolist() for b, n in zip(begins.tolist(), size.tolist(), strict=True)]
    before = -1
    for y in sorted(range(m), key=first.__getitem__):
        mine = number[begins[y] : begins[y] + size[y]]
        if before >= 0 and size[before] + size[y] - 2 * out[before, y] < size[y]:
            theirs = number[begins[before] : begins[before] + size[before]]
            held[theirs] = True
            gained = mine[~held[mine]]
            held[theirs] = False
            held[mine] = True
            lost = theirs[~held[theirs]]
            held[mine] = False
            out[y] = out[before] + counted(gained) - counted(lost)
        else:
            out[y] = counted(mine)
        before = y
    return out


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets link (boolean matrix)."""
    shared = overlaps(sets).astype(np.int64)
    n = np.array([len(s) for s in sets])
    return 100 * shared >= percent * (n[:, None] + n[None, :] - shared)


def roots(link: np.ndarray) -> np.ndarray:
    """The smallest index that each reaches."""
    link = link | np.eye(len(link), dtype=bool)
    label = np.arange(len(link))
    while True:
        least = np.where(link, label[None, :], len(label)).min(1)
        least = least[least]
        if (least == label).all():
            return label
        label = least




def _joined(members: DataFrame, percent: int, parts: int) -> DataFrame:
    """Links (a, b) within each (group, block) of members, one for each set that is not the first of its component."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(rows: list[tuple]) -> pa.RecordBatch:
            rows = sorted(set(rows))
            label = roots(linked([np.frombuffer(s, np.uint64) for _, s in rows], percent)) if len(rows) > 1 else np.zeros(1, int)
            ids = np.array([r[0] for r in rows], np.int64)
            more = label != np.arange(len(label))
            return pa.RecordBatch.from_arrays([pa.array(ids[more]), pa.array(ids[label[more]])], ["a", "b"])

        now, held = None, []
        for group, block, key, s in rows_of(b.slice(i, 64) for b in batches for i in range(0, b.num_rows, 64)):
            if held and now != (group, block):
                yield solve(held)
                held = []
            now = (group, block)
            held.append((key, s))
        if held:
            yield solve(held)

    return members.repartition(parts, "group", "block").sortWithinPartitions("group", "block", "id").mapInArrow(lean(run), "a long, b long")


def _crossed(members: DataFrame, percent: int, parts: int) -> DataFrame:
    """Links between blocks x < y of a group, of sets with different roots; members: (group, x, y, block, id, root, s)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(rows: list[tuple]) -> pa.RecordBatch:
            link = linked([np.frombuffer(r[3], np.uint64) for r in rows], percent)
            ids, root = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
            a, b = np.nonzero(link & (root[:, None] > root[None, :]))
            pairs = np.unique(np.stack([root[a], root[b]]), axis=1) if len(a) else np.zeros((2, 0), np.int64)
            del ids
            return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

        now, held = None, []
        for group, x, y, *rest in rows_of(b.slice(i, 64) for b in batches for i in range(0, b.num_rows, 64)):
            if held and now != (group, x, y):
                yield solve(held)
                held = []
            now = (group, x, y)
            held.append(tuple(rest))
        if held:
            yield solve(held)

    return members.repartition(parts, "group", "x", "y").sortWithinPartitions("group", "x", "y").mapInArrow(lean(run), "a long, b long")


def join_groups(members: DataFrame, large: DataFrame, percent: int, parts: int) -> DataFrame:
    """Links that connect all linked sets of each group; those found before a group of more than GROUP was looked at again are stars.

    members: (group, id, s); large: staged (group, m) with the number of members of groups of more than GROUP.
    """
    if large.isEmpty():
        return staged(_joined(members.withColumn("block", F.lit(0).cast("long")).select("group", "block", "id", "s"), percent, parts))
    members = staged(members)
    blocked = members.join(large, "group", "left").withColumn("block", F.when(F.col("m").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("id", "s"), F.ceil(F.col("m") / F.lit(GROUP // 2)))).cast("long"))
    links = staged(_joined(blocked.select("group", "block", "id", "s"), percent, parts))
    while True:
        # The first of each component stands for it in its group; those go on as a smaller problem.
        root = components(links, 0)
        rooted = blocked.where("m IS NOT NULL").join(root.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
        left = rooted.groupBy("group").agg(F.countDistinct("root").alias("k")).where("k > 1").select("group")
        open_ = staged(rooted.join(left, "group"))
        stars = root.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        if open_.isEmpty():
            return stars
        firsts = open_.where("id = root").select("group", "id", "s").distinct()
        sizes = firsts.groupBy("group").agg(F.count("*").alias("m"))
        again = firsts.join(sizes, "group").withColumn("block", F.pmod(F.xxhash64(F.lit(3), "id"), F.ceil(F.col("m") / F.lit(GROUP))).cast("long"))
        more = staged(_joined(again.select("group", "block", "id", "s"), percent, parts))
        if more.isEmpty():
            break
        links = staged(links.union(more))
    # What is left open: every two blocks of the group, but only between sets that aren't connected yet.
    last = open_.select("group", "block", "id", "root", "s", F.ceil(F.col("m") / F.lit(GROUP // 2)).cast("long").alias("g"))
    other = last.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - F.lit(1)))).where("o <> block OR g = 1")
    crossed = other.select("group", F.least("block", "o").alias("x"), F.greatest("block", "o").alias("y"), "block", "id", "root", "s")
    return staged(stars.union(_crossed(crossed, percent, parts)))


def similar(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for every row: the component by links of Jaccard similarity >= percent / 100.

    Null, empty and wordless texts have an empty set and link with nothing (component: their own id). Rows that
    repeat an id are nodes of that one id and so are in one component. Rows with a null id link with nothing
    and have a null component. Other columns aren't read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    profile = staged(profiles(rows, n))
    base = profile.where("kind = 0").select("id", "n", "digest")
    repeated = staged(profile.where("kind = 1").groupBy("id").agg(F.sum("n").alias("n"), F.min("ref").alias("ref")).where("n >= 8"))
    top = most_frequent(repeated, "n", HOT, "id").select("id", "ref").toArrow()  # bounded by HOT
    keys, refs = top.column(0).to_numpy().view(np.uint64), top.column(1).to_numpy()
    order = np.argsort(keys)
    hot = (keys[order].copy(), refs[order].copy())
    classes = staged(base.where("digest IS NOT NULL AND id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("rep")))
    named = staged(base.join(classes, "digest", "left").select("id", "n", "rep"))
    classed = named.where("rep IS NOT NULL AND id IS NOT NULL")
    found = _memberships(rows, n, percent, hot)
    size = F.col("n")
    asked = F.greatest(F.lit(1), F.floor(F.ceil(size * F.lit(percent) / F.lit(100)) / F.lit(EXTEND)))
    # One shuffle brings all of an id together: its hits, its groups (at most a prefix of one document) and its name.
    each = found.repartition("id").withColumn("hits", F.sum("hits").over(Window.partitionBy("id", "n")))
    enough = each.withColumn("enough", F.max(F.col("hits") >= asked).over(Window.partitionBy("id"))).where("enough")
    # A task sends one text of each class, whichever comes first; here its class's first document takes its place.
    kept = staged(enough.join(classed.select("id", "rep"), "id").select("group", F.col("rep").alias("id")).distinct())
    sizes = kept.groupBy("group").agg(F.count("*").alias("m")).where("m > 1")
    large = staged(sizes.where(F.col("m") > GROUP))
    wanted = kept.join(sizes, "group").groupBy("id").agg(F.collect_set("group").alias("groups"))  # at most a prefix of one document

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in texts_of(batches):
            out = [(g, key, shingle_set(text, n).tobytes()) for key, text, groups in held for g in groups]
            for at in range(0, len(out), 256):
                g, k, s = zip(*out[at : at + 256], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(k, pa.int64()), pa.array(s, pa.binary())], ["group", "id", "s"])

    members = rows.join(wanted.hint("shuffle_hash"), "id").select("id", "t", "groups").mapInArrow(lean(sets), "group long, id long, s binary")
    links = join_groups(members, large, percent, partitions(docs, 2.0))
    twice = classed.where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    # Copies of a class hang on its first; only firsts (and repeated ids) take part in the search for components.
    root = components(links.select("a", "b").union(twice.join(links.select(F.col("a").alias("x")).union(links.select(F.col("b").alias("x"))).distinct(), twice["a"] == F.col("x"), "left_semi")), 0)
    return named.join(root.withColumnRenamed("node", "rep"), "rep", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("root", "rep", "id").alias("component_id"))
