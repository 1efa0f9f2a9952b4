"""Operators with exact results, against plain ways to compute them."""

import base64
import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from cases import empty_documents, hard_documents

from lacustra.llm import bpe, decontaminate, knn, line_dedup, ngram_join, sharding, suffix_dedup
from lacustra.operators import graph


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


# 1


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def reference():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding_equals_the_library_and_decodes(spark, ranks, reference):
    docs = hard_documents(spark)
    got = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks).collect()
    expected = sorted((reference.encode_ordinary(r["text"] or ""), (r["text"] or "").encode()) for r in docs.collect())
    assert sorted((list(r["ids"]), bytes(r["decoded"])) for r in got) == expected
    assert bpe.encode(empty_documents(spark), ranks, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("piece", ["a" * 37, "a" * 64 + "b", "-" * 999, "=-" * 40, "abab" * 9, "é" * 7, "<|endoftext|>", "x"])
def test_merges_of_runs(ranks, reference, piece):
    ids, sizes = bpe.MergeReplay(ranks).encode([piece.encode(), b"", b"other"])
    assert ids[: sizes[0]].tolist() == reference._core_bpe.encode_single_piece(piece.encode()) and sizes[1] == 0


def test_parts_of_long_texts_do_not_change_pieces():
    import regex

    text = "some  words\n\n and'll more 123 things... " * 50
    find = regex.compile(public_tokenizers.PATTERN).findall
    assert [p for part in bpe.safe_parts(text, 64) for p in find(part)] == find(text)


# 2


def test_containment(spark):
    item = " ".join(f"w{i}" for i in range(30))
    rows = [(1, "before it. " + item.upper() + ", after"), (2, " ".join(item.split()[:25])), (3, " ".join(item.split()[:24])), (4, None), (5, ""), (None, item), (6, "w1 w2 w3 w4"), (7, f"{'x ' * 9000}{item}"), (7, "x")]
    bench = spark.createDataFrame([(10, item), (11, None), (12, ""), (13, "w1 w2 w3 w4"), (None, item)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["n_item"], r["n_shared"]) for r in decontaminate.contaminated(documents(spark, rows), bench).collect()}
    assert got == {(1, 10, 26, 26), (2, 10, 26, 21), (7, 10, 26, 26), (6, 13, 1, 1)}  # 20 of 26 is too few
    assert decontaminate.contaminated(empty_documents(spark), bench).count() == 0
    assert decontaminate.contaminated(hard_documents(spark), bench.limit(0)).count() == 0
    # Of the two rows with id 7 only the one that holds the item goes.
    left = decontaminate.clean(documents(spark, rows), bench)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in left.where("text IS NOT NULL").collect()) == [(0, item), (3, rows[2][1]), (5, ""), (7, "x")]
    assert left.where("text IS NULL").count() == 1
    clash = hard_documents(spark)
    assert decontaminate.clean(clash, bench).columns == clash.columns and decontaminate.clean(clash, bench).count() == clash.count()


def test_containment_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    test_containment(spark)


def test_decontamination_runs_no_python(spark):
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    plan = decontaminate.contaminated(hard_documents(spark), bench)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# 3


def plain_components(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}
    changed = True
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in pairs:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    return {i: (len(sets[i]), root[i]) for i in sets}


def near_copies(seed, groups=25, words=400):
    rng, rows = random.Random(seed), []
    for g in range(groups):
        base = [f"w{rng.randrange(words)}" for _ in range(rng.choice([3, 6, 20, 60, 150]))]
        for _ in range(rng.choice([1, 2, 5, 9])):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = f"w{rng.randrange(words)}"
            rows.append((len(rows) * 3 + g % 2, " ".join(copy)))
    return rows


@pytest.mark.parametrize("n,percent,group", [(4, 85, 1024), (5, 80, 1024), (2, 60, 1024), (4, 85, 4), (2, 60, 4)])
def test_components_equal_the_plain_way(spark, monkeypatch, n, percent, group):
    monkeypatch.setattr(ngram_join, "GROUP", group)
    rows = near_copies(n) + [(100_000, None), (100_001, ""), (100_002, "one two")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar(documents(spark, rows), n, percent).collect()}
    assert got == plain_components(rows, n, percent)


def test_components_of_hard_rows(spark):
    got = sorted(ngram_join.similar(hard_documents(spark)).collect(), key=lambda r: (r["doc_id"] or 0, r["n_shingles"]))
    assert [r["component_id"] for r in got] == [None, 1, 2, 3, 4, 5, 6, 7, 7, 7, 9]
    assert ngram_join.similar(empty_documents(spark)).count() == 0


def test_a_join_of_large_groups_takes_few_shuffles(spark, monkeypatch):
    plans, kept = [], ngram_join.staged
    for module in (ngram_join, graph):
        monkeypatch.setattr(module, "staged", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), kept(df))[1])
    monkeypatch.setattr(ngram_join, "GROUP", 8)
    common = " ".join(f"c{i}" for i in range(12))
    rows = near_copies(9) + [(1000 + i, f"{common} " + " ".join(f"o{i * 50 + k}" for k in range(12))) for i in range(40)]
    base = [f"b{i}" for i in range(120)]
    rows += [(2000 + i, " ".join([*base[:i], "x", *base[i + 1 :]])) for i in range(60)] + [(3000 + i, " ".join(base)) for i in range(80)]
    joined = ngram_join.similar(documents(spark, rows), 4, 85)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in joined.collect()}
    assert got == plain_components(rows, 4, 85)
    assert sum(p.count("Exchange hashpartitioning") for p in plans) <= 55  # each is a stage, whatever the size


def test_positions_cut_lists_only_where_nothing_links():
    rng = np.random.default_rng(4)
    base = np.sort(rng.choice(1 << 40, 100, replace=False)).astype(np.uint64)
    others = rng.integers(0, 1 << 30, (60, 100)).astype(np.uint64)  # smaller than most of base
    sets = [np.unique(np.where(rng.random(100) < share, other, base)) for share, other in zip(rng.choice([0.02, 0.05, 0.8], 60), others, strict=True)]
    size = np.array([len(s) for s in sets])
    linked = ngram_join.linked(sets, 80)
    cut = 0
    for t in base:
        where = [(int(np.searchsorted(s, t)), i) for i, s in enumerate(sets) if t in s]
        place, who = (np.array(x) for x in zip(*sorted(where), strict=True))
        block = np.cumsum(ngram_join.position_blocks(np.zeros(len(who), np.uint64), np.zeros(len(who), np.int64), place, size[who], 80))
        cut += block[-1] > 1
        assert not (linked[np.ix_(who, who)] & (block[:, None] != block[None, :])).any()
    assert cut


def test_overlaps_from_differences():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.choice(60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(40)] + [np.arange(50, dtype=np.uint64)] * 60
    expected = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert (ngram_join.overlaps(sets) == expected).all()


# 4


def plain_lines(rows, percent=80):
    lines = [(i, k, set(line_dedup.line_words(x))) for i, t in sorted(rows) for k, x in enumerate(line_dedup.lines_of(t))]
    gone = {}
    for at, (i, k, s) in enumerate(lines):
        if s and any(o and 100 * len(s & o) >= percent * len(s | o) for _, _, o in lines[:at]):
            gone.setdefault(i, set()).add(k)
    return {i: "\n".join(x for k, x in enumerate(line_dedup.lines_of(t)) if k not in gone[i]) if i in gone else t for i, t in rows}


@pytest.mark.parametrize("percent,group,common", [(80, 1024, 2000), (80, 3, 2000), (60, 1024, 5), (90, 1024, 0)])
def test_lines_equal_the_plain_way(spark, monkeypatch, percent, group, common):
    monkeypatch.setattr(line_dedup, "GROUP", group)
    if group == 3:  # small pieces of everything
        for name, value in {"TRIES": 1, "SMALL": 4, "WINDOW": 2, "LONG": 5, "LONE": 6, "WORDS": 20, "TEXT": 500}.items():
            monkeypatch.setattr(line_dedup, name, value)
    monkeypatch.setattr(line_dedup, "COMMON", common)
    rng, rows = random.Random(percent), []
    pool = [[f"w{rng.randrange(90)}" for _ in range(rng.choice([1, 2, 3, 4, 5, 8, 20]))] for _ in range(30)]
    for i in range(60):
        lines = []
        for _ in range(rng.randrange(6)):
            line = list(rng.choice(pool))
            if rng.random() < 0.6:
                line[rng.randrange(len(line))] = f"W{rng.randrange(90)}"
            lines.append(" ".join(line))
        rows.append((i, "\n".join(lines) if i % 9 else None))
    got = {r["doc_id"]: r["kept"] for r in line_dedup.deduplicated(documents(spark, rows), percent).collect()}
    assert got == plain_lines(rows, percent)


def test_lines_of_hard_rows(spark):
    docs = hard_documents(spark)
    got = line_dedup.deduplicated(docs, carry=("lang", "id", "k")).collect()
    assert len(got) == docs.count() and sum(r["n_removed"] for r in got) == 2 and {r["rest"]["k"] for r in got} == {3}
    assert {r["kept"] for r in got if r["doc_id"] in (1, 2, 9)} == {None, "", "\n\n***\n---"}
    assert line_dedup.deduplicated(empty_documents(spark)).count() == 0
    with pytest.raises(ValueError):
        line_dedup.deduplicated(docs, 50)


def test_long_lines_of_common_words_only(spark, monkeypatch):
    """More than 130 common words in a prefix: copies in other chunks are found as well."""
    monkeypatch.setattr(line_dedup, "COMMON", 2)
    words = [f"w{k}" for k in range(1000)]
    rows = [(i, " ".join((words if i < 3 else [*words[:i], f"own{i}", *words[i + 1 :]]) * 4)) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(9, "doc_id")
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.deduplicated(docs).collect()}
    assert got == {i: int(i > 0) for i in range(9)}


# 5


def test_search_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(700, 8)), 3)
    x[100:300] = x[100]
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(2000, None), (2001, [1.0, None] * 4), (2002, [float("nan")] * 8), (2100, [float("inf")] * 8), (2200, []), (3000, [2.0, 1.0]), (3001, [1.0, 1.0]), (0, [float(v) for v in x[0]])]
    vectors = knn.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5))
    got = {}
    for r in knn.top_k(vectors, vectors.where("id % 100 = 0"), 10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ints = np.floor(1024 * x).astype(np.int64)
    assert set(got) == {0, 100, 200, 300, 400, 500, 600, 3000}
    for q in range(0, 700, 100):
        s = ints @ ints[q]
        best = sorted((i for i in range(700) if i != q), key=lambda i: (-s[i], i))[:10]
        assert sorted(got[q]) == [(k, i, s[i]) for k, i in enumerate(best, 1)]
    assert got[3000] == [(1, 3001, 3 * 1024 * 1024)]
    assert knn.top_k(vectors.limit(0), vectors.limit(0)).count() == 0


def test_search_of_clusters_leaves_most_cells_out(spark):
    """Clustered vectors: equal to brute force, and each query visits few of the cells."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16)) * 5000
    x = (centres[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 16)) * 100).astype(np.int64)
    vectors = spark.createDataFrame([(i, [int(v) for v in row]) for i, row in enumerate(x)], "id long, v array<long>").repartition(4)
    got = {}
    for r in knn.top_k(vectors, vectors.where("id % 100 = 0"), 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in range(0, 3000, 100):
        s = x @ x[q]
        best = sorted((i for i in range(3000) if i != q), key=lambda i: (-s[i], i))[:5]
        assert sorted(got[q]) == [(k, i, s[i]) for k, i in enumerate(best, 1)]
    pivots = knn.choose_pivots(x[:1000], 27)
    cell = knn.cells_of(x.astype(float), pivots)
    far = lambda c, i: float(np.sqrt(((x[cell == i] - c) ** 2).sum(1)).max())
    present = np.unique(cell)
    cells = knn.Cells(present, pivots[present], np.bincount(cell)[present], np.array([far(pivots[i], i) for i in present]), np.array([far(0, i) for i in present]))
    asked = x[::100]
    least = np.sort(asked @ x.T, axis=1)[:, -5]
    visits = cells.first(asked, 5) | cells.later(asked, 5, least)
    assert visits.mean() < 0.25 and (cells.bounds(asked) + 1e-3 >= np.stack([(asked @ x[cell == i].T).max(1) for i in present], 1)).all()


def test_products_stay_exact_beyond_floats():
    big = np.array([[2**31 - 1, 2**30 + 1]])
    assert knn.products(big, big)[0, 0] == (2**31 - 1) ** 2 + (2**30 + 1) ** 2


# 7


def test_shards(spark):
    docs = hard_documents(spark).union(spark.createDataFrame([(100 + i, f"text {i % 7}", "en", "s", 0, 1, 2, 3, 4) for i in range(500)], hard_documents(spark).schema))
    got = sharding.with_slots(sharding.shuffled_shards(docs, bucket_bytes=40_000)).collect()
    assert len(got) == docs.count()
    by = {}
    for r in got:
        by.setdefault(r["_shard"], []).append(r["_slot"])
        assert r["_grown_shard"] in (r["_shard"], 16)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(16))
    assert len({(r["doc_id"], r["_shard"]) for r in got}) == len({r["doc_id"] for r in got})
    assert sorted(zlib.crc32((r["text"] or "").encode()) for r in got) == sorted(zlib.crc32((r["text"] or "").encode()) for r in docs.collect())
    assert sharding.shuffled_shards(empty_documents(spark)).count() == 0
    with pytest.raises(ValueError):
        sharding.shuffled_shards(docs.withColumnRenamed("k", "_AT"))


def test_fisher_yates_is_seeded_and_even():
    assert sorted(sharding.fisher_yates(100, 3)) == list(range(100)) and sharding.fisher_yates(100, 3) == sharding.fisher_yates(100, 3)
    assert sharding.fisher_yates(0, 1) == [] and sharding.fisher_yates(1, 1) == [0]
    firsts = [sharding.fisher_yates(4, s)[0] for s in range(4000)]
    assert all(800 < firsts.count(k) < 1200 for k in range(4))


def test_write_shards(spark, tmp_path):
    sharding.write_shards(hard_documents(spark), f"{tmp_path}/out", shards=4)
    again = spark.read.parquet(f"{tmp_path}/out")
    assert again.count() == hard_documents(spark).count() and again.where("_shard > 3").count() == 0


# 9


def plain_repeats(rows, width=100):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - width + 1):
            w = raw[s : s + width]
            if w in seen:
                gone[s : s + width] = b"\1" * width
            seen.add(w)
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out[i] = (len(raw), sum(gone), spans, kept)
    return out


@pytest.mark.parametrize("often", [200_000, 3])
def test_repeats_equal_the_plain_way(spark, monkeypatch, often):
    monkeypatch.setattr(suffix_dedup, "OFTEN", often)
    rng = random.Random(9)
    make = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    passages = [make(n) for n in (99, 100, 101, 150, 400)]
    rows = [(i, "".join(rng.choice([make(rng.randrange(200)), rng.choice(passages)]) for _ in range(rng.randrange(5)))) for i in range(80)]
    rows += [(900, "x" * 1000), (901, "x" * 99), (902, None), (903, rows[3][1]), (904, "ab" * 300)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.without_repeats(documents(spark, rows)).collect()}
    assert got == plain_repeats(rows)


def test_repeats_of_hard_rows(spark):
    got = suffix_dedup.without_repeats(hard_documents(spark)).collect()
    assert len(got) == hard_documents(spark).count() and None in {r["doc_id"] for r in got}
    assert suffix_dedup.without_repeats(empty_documents(spark)).count() == 0


@pytest.mark.parametrize("letters", [1, 2, 3, 26])
def test_suffix_order(letters):
    rng = np.random.default_rng(letters)
    for n in (0, 1, 2, 50, 600):
        d = rng.integers(97, 97 + letters, n).astype(np.uint8)
        b = d.tobytes()
        assert [b[i : i + 100] for i in suffix_dedup.suffix_array(d)] == [b[i : i + 100] for i in sorted(range(n), key=lambda i: b[i:])]


@pytest.mark.parametrize("block", [1, 61, 100, 1 << 16])
def test_anchors_by_blocks(monkeypatch, block):
    """Those of each window alone, wherever blocks end."""
    rng = random.Random(block)
    raw = [bytes(rng.choice(letters) for _ in range(n)) for letters in (b"x", b"ab", b"abcdefgh ") for n in (0, 99, 100, 101, 500, 99)]
    want = []
    for k, text in enumerate(raw):
        for a in range(len(text) - suffix_dedup.WIDTH + 1):
            hashes = suffix_dedup.gram_hashes(np.frombuffer(text[a : a + suffix_dedup.WIDTH], np.uint8))
            at = int(np.argmin(hashes >> np.uint64(8)))
            if want and want[-1][:2] == [k, a + at]:
                want[-1][4] = a
            else:
                want.append([k, a + at, int(hashes[at]), a, a])
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    got = suffix_dedup.anchors(np.array([len(x) for x in raw], np.int64), np.frombuffer(b"".join(raw), np.uint8))
    assert [list(x) for x in zip(*(c.tolist() for c in got), strict=True)] == want


def test_memory_of_a_chunk():
    """Two tasks of an executor hold a chunk at once, beside a heap of 60 % of its memory."""
    data = np.random.default_rng(0).integers(97, 123, suffix_dedup.CHUNK).astype(np.uint8)
    sizes = np.full(len(data) // 2048, 2048)
    part = data[: suffix_dedup.SORTED]
    order = suffix_dedup.suffix_array(part)
    for run, most in ((lambda: suffix_dedup.anchors(sizes, data), 8 * len(data)), (lambda: suffix_dedup.suffix_array(part), 40 * len(part)), (lambda: suffix_dedup.equal_windows(part, order), 40 * len(part))):
        tracemalloc.start()
        run()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < most


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_large_groups_of_segments(monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "SORTED", most)
    rng = random.Random(most)
    make = lambda n, letters="ab": bytes(rng.choice(letters.encode()) for _ in range(n))
    for sides in (1, 2, 5, 60):
        left, right = [make(rng.randrange(70)) for _ in range(sides)], [make(rng.randrange(70)) for _ in range(sides)]
        middle = make(60, "abc")
        texts = [x for x in (rng.choice(left) + middle + rng.choice(right) for _ in range(120)) if len(x) >= 100]
        group = [(x, rng.randrange(50), 0, 1000 * k) for k, x in enumerate(texts)]
        rng.shuffle(group)
        windows = {}
        for x, i, v, start in group:
            for a in range(len(x) - 99):
                windows.setdefault(x[a : a + 100], []).append((i, start + a))
        want = {p for places in windows.values() for p in places if p != min(places)}
        assert {(i, p) for i, _, a, b in suffix_dedup.settle([group]) for p in range(a, b + 1)} == want


def test_memory_of_a_common_line():
    """Of segments around it, hardly anything else comes again."""
    rng = random.Random(0)
    side = lambda: bytes(rng.choices(range(97, 123), k=40))
    group = [(side() + b"x" * 50 + side(), i, 0, 10) for i in range(20_000)]
    tracemalloc.start()
    assert not list(suffix_dedup.settle([group]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 << 20


def test_digest_columns(spark, ranks):
    rows = bpe.digest(bpe.decode(bpe.encode(hard_documents(spark), ranks, public_tokenizers.PATTERN), ranks)).where("doc_id = 2").collect()
    assert rows[0]["n_tokens"] == 0 and rows[0]["ids_sha256"] == rows[0]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()


def test_lists_in_small_and_large_pieces_give_the_same_candidates():
    rng = np.random.default_rng(6)
    text = "\n".join(" ".join(f"w{rng.integers(40)}" for _ in range(rng.integers(5, 12))) for _ in range(300)).encode()
    sets = line_dedup.LineSets(text, np.zeros(1 << 18, np.uint8))
    every = np.arange(300)
    given = np.zeros(300, np.int64), sets.bits(every, 1), sets.sizes, np.zeros(300, np.int64), 60
    found = []
    for small, window in ((400, 512), (0, 512), (0, 7)):
        row, host, more = line_dedup.candidates(*given, 400, small, window)
        assert not more.any()
        found.append(set(zip(row.tolist(), host.tolist(), strict=True)))
    words = [set(x.split()) for x in text.split(b"\n")]
    true = {(i, j) for i in range(300) for j in range(i) if line_dedup.matches(words[i], words[j], 60)}
    assert found[0] == found[1] == found[2] and true and true <= found[0]
    for small in (400, 0):
        row, host, more = line_dedup.candidates(*given, 2, small, 7)
        few = set(zip(row.tolist(), host.tolist(), strict=True))
        assert few == {(i, j) for i, j in found[0] if sum(a == i and b < j for a, b in found[0]) < 2}
        assert set(np.flatnonzero(more)) == {i for i, _ in found[0] - few}


def test_line_sets_equal_sets_of_words():
    rng = random.Random(4)
    lines = [" ".join(rng.choice(["Été", "a", "A", "bb", "***", "longer-than-eight", "日本", "x" * 70, "\t"]) for _ in range(rng.randrange(9))) for _ in range(200)]
    sets = line_dedup.LineSets("\n".join(lines).encode(), np.zeros(1 << 18, np.uint8))
    words = [set(line_dedup.line_words(x)) for x in lines]
    assert sets.line.tolist() == [i for i, w in enumerate(words) if w]
    assert sets.sizes.tolist() == [len(w) for w in words if w]
    names = {}
    for i, h in zip(sets.line.tolist(), zip(*(x.tolist() for x in sets.hashes), strict=True), strict=True):
        assert names.setdefault(frozenset(words[i]), h) == h
    assert len(set(names.values())) == len(names)
