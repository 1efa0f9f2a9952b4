"""Operators that learn, by held-out accuracy and by their parts; and the pipeline."""

import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from cases import empty_documents, hard_documents
from pyspark.sql import functions as F

import corpus_pipeline
from lacustra.llm import langid, lm, queries, toxicity

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = db.sql(queries.ORACLE_SQL[name])
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(rel.columns)
    assert columns == sorted(df.columns)
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(rel.project(", ".join(columns)).fetchall())


def prose(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def test_language(spark):
    got = queries.op8_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 0.97 * len(got) and all(0 <= r["score"] <= 1 for r in got)


def test_language_of_hard_rows(spark):
    docs = hard_documents(spark)
    model = langid.train(docs.where("doc_id <> 5"))
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, model).collect()}
    assert got[1] == got[2] == got[9] == "und" and got[5] == "en"
    assert langid.train(empty_documents(spark)).languages == [] and {r["lang_pred"] for r in langid.predict(docs, langid.train(empty_documents(spark))).collect()} == {"und"}
    assert langid.predict(empty_documents(spark), model).count() == 0


def test_word_scores_are_exact(spark):
    rows = [(1, "The cat the dog"), (2, "the  bird\n"), (3, None), (4, "never seen words"), (None, "cat")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm.score(docs, docs.where("doc_id IN (1, 2)")).collect()}
    counts = Counter("the cat the dog".split()) + Counter("the bird".split()) + Counter({"</s>": 2})
    n, v = sum(counts.values()), len(counts)
    for i, text in rows:
        words = (text or "").lower().split() + ["</s>"]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(w in counts for w in words), n)
        assert r["base_score"] == pytest.approx(base) and r["score"] < 0


def test_words_beyond_the_frequent_ones(spark, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 1)
    test_word_scores_are_exact(spark)


def test_mixing_learns(spark):
    rng = random.Random(0)
    words = ["".join(rng.choice("etaoin") for _ in range(rng.randrange(2, 8))) for _ in range(50)]
    docs = spark.createDataFrame([(i, prose(rng, words, 80)) for i in range(60)] + [(100, prose(random.Random(1), ["xqzj", "vkwp"], 80))], "doc_id long, text string")
    got = {r["doc_id"]: r["bits_per_byte"] for r in lm.score(docs, docs.where("doc_id < 50")).collect()}
    assert max(got[i] for i in range(50, 60)) < 2.5 < got[100]
    assert lm.score(hard_documents(spark), empty_documents(spark)).count() == hard_documents(spark).count()
    assert lm.score(empty_documents(spark), docs).count() == 0


def varied_words(n):
    rng = random.Random(4)
    return ["".join(rng.choice("etaoinx") for _ in range(rng.randrange(1, 7))) for _ in range(n)]


def test_contexts_share_no_counts(spark, monkeypatch):
    """Scores don't depend on the size of any table, nor counts on how tokens are dealt out."""
    rng, words = random.Random(5), varied_words(120)
    docs = spark.createDataFrame([(i, prose(rng, words, 40)) for i in range(30)], "doc_id long, text string")
    usual = {r["doc_id"]: r["score"] for r in lm.score(docs, docs.where("doc_id < 20")).collect()}
    monkeypatch.setattr(lm, "SLOT_BITS", 6)
    monkeypatch.setattr(lm, "SLOTS", 64)
    assert {r["doc_id"]: r["score"] for r in lm.score(docs, docs.where("doc_id < 20")).collect()} == pytest.approx(usual)


def test_counts_along_paths_are_exact(spark):
    rng, words = random.Random(6), varied_words(60)
    table = {(rng.randrange(4) << 16 | rng.choice([0, 0xC3A9]), w.encode() + b" "): rng.choice([0, 1, 7, 2**33]) for w in words * 2}

    def contexts(state, t, at):
        place = (state >> 16,)
        back = [(place + tuple(t))[max(0, at + 1 - k) : at + 1] + (("short",) if at < k - 1 else ()) + (("first",) if at < k else ()) for k in (1, 2, 3)]
        return [*back, (place, t[:at]), (state, t[:at])]

    seen = Counter()
    for (state, t), n in table.items():
        for at, byte in enumerate(t):
            for i, c in enumerate(contexts(state, t, at)):
                for j in range(9):
                    seen[i, c, byte >> 8 - j, j] += n
    dealt = lm.parts_of(spark.createDataFrame([(*k, n) for k, n in table.items()], "state int, token binary, n long"), 5)
    known = lm.known_parts(dealt.union(lm.answers(dealt, 8)), 2).toArrow().to_batches()
    got = 0
    for part in lm.known_tokens(known, 8):
        tokens, path = part.tokens, part.path[part.of]
        assert [table[k] for k in zip(part.states.tolist(), tokens, strict=True)] == part.n.tolist()
        whole = [(i, at, s, t) for i in range(5) for s, t in zip(part.states.tolist(), tokens, strict=True) for at in range(len(t))]
        for (i, at, s, t), counts in zip(whole, path.reshape(-1, 9).tolist(), strict=True):
            assert counts == [seen[i, contexts(s, t, at)[i], t[at] >> 8 - j, j] for j in range(9)]
        got += len(tokens)
    assert got == len(table)


def test_frequent_tokens_count_in_full(spark):
    """The mixture is learned with every occurrence: one token of a million outweighs 300 of a thousand each."""
    rng = random.Random(7)
    table = {"".join(rng.choice("etaoinx") for _ in range(6)).encode() + b" ": 1000 for _ in range(300)} | {b"zz ": 10**6}
    dealt = lm.parts_of(spark.createDataFrame([(0, *x) for x in table.items()], "state int, token binary, n long"), 1)
    known = dealt.union(lm.answers(dealt, 4))
    costs = lm.token_costs(known, 1, 4, lm.train(known, len(table), 4)).collect()
    assert [r["cost"] for r in costs if r["n"] == 10**6][0] > -0.2 and len({r["name"] for r in costs}) == len(table)


def test_token_probabilities_add_up():
    """The bits' probabilities of all values of a byte add up to 1."""
    mixer = lm.Mixer.fresh(np.random.default_rng(0).random((lm.PREDICTORS, lm.SLOTS)).astype(np.float32), np.ones((lm.PREDICTORS, lm.SLOTS), np.float32))
    total = (10 ** mixer.costs([bytes([c]) for c in range(256)], np.full(256, 1 << 16))).sum()
    assert total == pytest.approx(1, abs=1e-4)
    tokens = lm.tokens_of("a bc\n  d")
    assert b"".join(tokens) == b"a bc\n  d\xff" and tokens[-1] == b"d\xff"


def test_tokens_of_many_texts_at_once():
    rng = random.Random(8)
    texts = ["".join(rng.choice(["a", "long-word-of-many-bytes", ".", " ", "\n", "é", "ß", "Ж", "日", "\t", "!"]) for _ in range(rng.randrange(40))) for _ in range(60)] + ["", "é", ". ."]
    cut = lm.Cut([t.encode() for t in texts])
    tokens = [lm.tokens_of(t) for t in texts]
    flat = [t for ts in tokens for t in ts]
    states = [s for ts in tokens for s in lm.states_of(ts)]
    assert cut.tokens(np.arange(len(cut.size))).to_pylist() == flat and cut.state.tolist() == states
    assert cut.text.tolist() == [i for i, ts in enumerate(tokens) for _ in ts] and cut.bounds.tolist() == np.cumsum([0, *map(len, tokens)])[:-1].tolist()
    names = {}
    for key, name in zip(zip(states, flat, strict=True), cut.name.tolist(), strict=True):
        assert names.setdefault(key, name) == name
    assert len(set(names.values())) == len(names)
    size = np.array([len(t) for t in flat])
    assert (lm.names_of(b"".join(flat), np.cumsum(size) - size, size, np.array(states)) == cut.name).all()


def plain_costs(part, mixer):
    """log10 of the tokens' probabilities, bit by bit from the definitions."""
    out = []
    for k, t in enumerate(part.tokens):
        total = 0.0
        for at, byte in enumerate(t):
            paths = [part.path[part.of[i, part.starts[k] + at]] for i in range(lm.PREDICTORS)]
            for j in range(8):
                bit, guesses, n = byte >> 7 - j & 1, [], []
                for path in paths:
                    same, other = path[j + 1], path[j] - path[j + 1]
                    one, zero = (same, other) if bit else (other, same)
                    n.append(path[j])
                    guesses.append(min(8.0, max(-8.0, math.log((one + 0.35) / (zero + 0.35)))))
                by_place = 1 + sum(n[3] >= x for x in lm.SEEN) if n[3] else int(n[2] > 0)
                gate = (by_place + 6 * sum(n[4] >= x for x in lm.SEEN)) * 16 + j * 2 + (at > 0)
                x = min(8.0, max(-8.0, sum(float(mixer.weights[gate, i]) * g for i, g in enumerate(guesses))))
                p = 0.5 / (1 + math.exp(-x)) + 0.5 * float(mixer.refined[j, round((x + 8) * 2)])
                total += math.log10(p if bit else 1 - p)
        out.append(total)
    return out


def test_costs_equal_a_plain_mixer(spark):
    rng, words = random.Random(9), varied_words(40)
    table = {(rng.choice([1 << 16, 3 << 16 | 0xC3A9]), w.encode() + rng.choice([b" ", b"\n", b"\xff"])): rng.choice([0, 1, 3, 900]) for w in words * 3}
    dealt = lm.parts_of(spark.createDataFrame([(*k, n) for k, n in table.items()], "state int, token binary, n long"), 2)
    whole = dealt.union(lm.answers(dealt, 4))
    mixer = lm.train(whole, len(table), 4)
    got = {r["name"]: r["cost"] for r in lm.token_costs(whole, 2, 4, mixer).collect()}
    for part in lm.known_tokens(lm.known_parts(whole, 2).toArrow().to_batches(), 4):
        size = np.array([len(t) for t in part.tokens])
        names = lm.names_of(b"".join(part.tokens), np.cumsum(size) - size, size, part.states).view(np.int64).tolist()
        assert [got[n] for n in names] == pytest.approx(plain_costs(part, mixer), rel=1e-4, abs=1e-4)


def test_held_out_bits_are_fewer_than_the_words_alone(spark):
    """Per byte, case, white space and spelling included, against word counts that ignore them."""
    rows = queries.op6_lm_scoring(spark, "/root/testdata/sf0.01").where("held_out").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"), "doc_id").collect()
    n = sum(len((r["text"] or "").encode()) + 1 for r in rows)
    model, base = (-sum(r[c] for r in rows) * math.log2(10) / n for c in ("score", "base_score"))
    assert model < base


TOXIC, CLEAN = ["dreckskerl", "vollhonk"], [f"wort{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(10)]


def labelled(spark, n=400):
    rng, rows, labels = random.Random(2), [], []
    for i in range(n):
        bad = i % 4 == 0
        words = [rng.choice(CLEAN) for _ in range(rng.randrange(20, 80))]
        for _ in range(3 if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(TOXIC) + rng.choice(["", "en", "s"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (5000, None)], "doc_id long, toxic int")


def test_toxicity_is_learned_and_folded(spark):
    docs, labels = labelled(spark)
    model = toxicity.train(docs, labels.where("doc_id % 3 <> 1 OR doc_id IS NULL"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert all((s >= 0.7) == (i % 4 == 0) for i, s in got.items())
    disguised = "wortaa wortbb Dr3ckskеrl wortcc V0LLH0NK wortdd dreck​skerl"
    said = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame([(1, disguised), (2, None), (3, ""), (None, "wortaa")], "doc_id long, text string"), model).collect()}
    assert said[1] >= 0.7 and all(0 <= said[i] < 0.7 for i in (2, 3, None))
    hard = hard_documents(spark)
    assert toxicity.rejected(hard, model).count() == hard.count() and toxicity.rejected(docs, model).count() == 300
    assert toxicity.score(empty_documents(spark), model).count() == 0


def test_toxicity_without_labels(spark):
    docs, labels = labelled(spark, 40)
    model = toxicity.train(docs, labels.limit(0))
    assert max(r["score"] for r in toxicity.score(docs, model).collect()) < 0.5


def test_exception_phrases():
    model = toxicity.ToxicityModel({" trash": 3.0}, frozenset({"white trash bag", "trash bag"}))
    assert model.weigh(toxicity.fold("a trash bag"))[0] == 0 and model.weigh(toxicity.fold("you trash"))[0] == 3.0 and model.weigh(toxicity.fold("pack trashed"))[0] == 3.0


def test_folding_leaves_numbers_alone():
    assert toxicity.fold("In 1984, 3 men; tr4sh $tupid ТRASH") == " in men trash stupid trash "
    assert toxicity.fold(None) == "  " or toxicity.fold(None).strip() == ""


def test_pipeline_stages(spark, tmp_path):
    """Each stage against what it should do on planted rows."""
    rng = random.Random(3)
    docs, labels = labelled(spark, 200)
    item = " ".join(f"test{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40))
    body = [prose(rng, CLEAN, 60) for _ in range(4)]
    near = body[0].split()
    near[30] = "anders"
    extra = [(9000, body[0]), (9001, " ".join(near)), (9002, body[0]), (9003, f"{body[1]}\n{body[2]}"), (9004, f"{body[2]}\nown words here"), (9005, f"{body[3]} {item}"), (9006, None), (9007, "")]
    table = docs.union(spark.createDataFrame(extra, docs.schema)).selectExpr("doc_id", "text", "'de' AS lang", "'s' AS source", "CAST(length(text) AS long) AS n_chars")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert not [i for i in rows if i < 200 and i % 4 == 0] and len([i for i in rows if i < 200]) == 150
    assert {i for i in rows if i >= 9000} == {9000, 9003, 9004, 9006, 9007}
    assert rows[9004]["text"] == "own words here" and rows[9003]["n_tokens"] == len(rows[9003]["ids"]) > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_join", "decontamination", "byte_bpe"] and corpus_pipeline.ORACLE_SQL is None


LONG = "\n".join(" ".join(f"zeile{i}x{j}" for j in range(40)) for i in range(500))


def test_pipeline_of_hard_rows(spark, tmp_path):
    """Null and repeated ids, null, empty and long texts, columns with names that stages use themselves, and no rows at all."""
    item = " ".join(f"prüfung{i}" for i in range(30))
    rows = [
        (1, "eins zwei drei vier fünf sechs sieben acht"),
        (1, "ganz andere worte unter derselben nummer als zuvor"),
        (1, "eins zwei drei vier fünf sechs sieben acht"),
        (2, f"vorher {item} nachher"),
        (2, "unter der nummer zwei steht auch etwas sauberes hier"),
        (None, "ohne nummer eins zwei und mehr worte die bleiben"),
        (None, "ohne nummer aber wieder mit ganz eigenen worten darin"),
        (3, None),
        (4, ""),
        (5, LONG),
        (6, LONG + "\nund noch eine zeile am ende"),
        (7, "   "),
    ]
    table = spark.createDataFrame([(i, t, "de", "s", len(t or ""), 1, 2, 3, 4) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _node long, _hit long, id long, k long")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    table.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    for at in (tmp_path, f"{tmp_path}/none"):
        spark.createDataFrame([(1, 0)], "doc_id long, toxic int").limit(0).write.parquet(f"{at}/labels.parquet")
        spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    docs = table
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == table.columns and {(r["_node"], r["_hit"], r["id"], r["k"]) for r in docs.collect()} <= {(1, 2, 3, 4)}
    kept = sorted(((r["doc_id"] or 0, r["text"] or "") for r in corpus_pipeline.run(spark, str(tmp_path)).collect()), key=str)
    # Of the lines of texts 5 and 6 the first ones stay; of rows 1 that agree in all, the second's line is no earlier one.
    expected = [(0, rows[5][1]), (0, rows[6][1]), (1, rows[0][1]), (1, rows[1][1]), (2, rows[4][1]), (3, ""), (4, ""), (5, LONG), (6, "und noch eine zeile am ende"), (7, "   ")]
    assert kept == sorted(expected, key=str)
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


@pytest.mark.parametrize("sf,least,most", [("0.01", 0.75, 0.05), ("0.1", 0.9, 0.01)])
def test_toxic_texts_held_out(spark, sf, least, most):
    """Shares of toxic texts found and of others reported; sf0.01 has 18 held-out toxic texts and 33 to learn from."""
    labels = spark.read.parquet(f"/root/testdata/sf{sf}/labels.parquet")
    rows = queries.op10_toxicity(spark, f"/root/testdata/sf{sf}").where("held_out").join(labels, "doc_id").where("toxic IS NOT NULL").collect()
    found = [sum(r["predicted"] for r in rows if r["toxic"] == y) / sum(r["toxic"] == y for r in rows) for y in (1, 0)]
    assert found[0] >= least and found[1] <= most and all(0 <= r["score"] <= 1 for r in rows)


def test_letters_of_all_planes(spark):
    docs = spark.createDataFrame([(1, "plain text"), (2, chr(0x32000) * 3)], "doc_id long, text string").withColumn("lang", F.lit("en"))
    model = langid.train(docs)
    assert {r["lang_pred"] for r in langid.predict(docs, model).collect()} == {"en"}
