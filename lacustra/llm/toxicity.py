"""Toxicity by a weighted lexicon.

Texts are folded first: lower case, homoglyphs of other scripts to Latin letters, digits and signs that stand
for letters inside words, everything that isn't a letter to a space. An Aho-Corasick automaton finds lexicon
entries at word starts (stems) or as whole words. The weights of the hits, without those in exception phrases,
are normalised by the text's length in a two-feature logistic model.

Lexicon, exceptions and model are learned from a bounded sample of labelled rows (SAMPLE_TOXIC and SAMPLE_CLEAN
rows, picked by a hash of the id); scoring covers every text as a whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, rows_of, staged

#: Bounds of the labelled sample, in rows.
SAMPLE_TOXIC, SAMPLE_CLEAN = 3000, 12000
#: In how many distinct toxic texts an entry must be, which share of its texts must be toxic (both labels weighing
#: alike), and how many entries each toxic text should have, where there are any.
MIN_TEXTS, MIN_PRECISION, COVER = 3, 0.85, 3
STEM_LENGTHS = range(4, 13)

# Letters of other scripts that look like Latin ones, and signs that stand for letters.
HOMOGLYPHS = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "ԁ": "d", "ɡ": "g", "ӏ": "l", "α": "a", "ο": "o", "ρ": "p", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "τ": "t", "υ": "u", "χ": "x"}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i"}

_FULLWIDTH = {0xFF41 + i: chr(97 + i) for i in range(26)}
_FOLDS = {ord(k): v for k, v in HOMOGLYPHS.items()} | _FULLWIDTH
_STRANGE = re.compile("[" + "".join(map(chr, _FOLDS)) + "​-‏­⁠﻿]")
_HIDDEN = re.compile("[​-‏­⁠﻿]")
_SIGN = re.compile(r"(?<=[^\W\d_])[01345789@$!]+(?=[^\W\d_])|(?<![^\W_])[01345789@$]+(?=[^\W\d_]{2})")
_OTHER = re.compile(r"[\W\d_]+")
_SIGN_TABLE = str.maketrans(SIGNS)


def fold(text: str | None) -> str:
    """Folded words, one space before, between and after them."""
    s = (text or "").lower()
    if not s.isascii() and _STRANGE.search(s):
        s = _HIDDEN.sub("", s).translate(_FOLDS)
    s = _SIGN.sub(lambda m: m[0].translate(_SIGN_TABLE), s)
    return f" {_OTHER.sub(' ', s).strip()} "


def features(folded: str) -> set[str]:
    """Whole words (a space on both sides) and stems (a space before) of a folded text."""
    out = set()
    for w in set(folded.split()):
        if len(w) >= 3:
            out.add(f" {w} ")
            out.update(f" {w[:k]}" for k in STEM_LENGTHS if k < len(w))
    return out


@dataclass
class ToxicityModel:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()
    coefficients: tuple[float, float, float] = (-4.0, 0.0, 0.0)  # bias, log(1 + weight), log(1 + words)
    _automaton: object = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_automaton"}

    def __setstate__(self, state):
        self.__dict__.update(state, _automaton=None)

    def automaton(self):
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                self._automaton.add_word(entry, (len(entry), weight))
            self._automaton.make_automaton()
        return self._automaton

    def weigh(self, folded: str, phrases: Counter | None = None) -> tuple[float, int]:
        """Sum of the weights of the words hit (a word counts by its heaviest entry) and the number of words."""
        words = folded.count(" ") - 1
        if not self.weights:
            return 0.0, words
        best: dict[int, float] = {}
        for end, (size, weight) in self.automaton().iter(folded):
            start = end - size + 1
            if weight > best.get(start, 0.0):
                best[start] = weight
        total = 0.0
        for start, weight in best.items():
            if self.exceptions or phrases is not None:
                end = folded.index(" ", start + 1)
                left = folded[folded.rfind(" ", 0, start) + 1 : end] if start else ""
                right = folded[start + 1 : folded.find(" ", end + 1)] if end + 1 < len(folded) else ""
                if phrases is not None:
                    phrases.update({left, right} - {""})
                if left in self.exceptions or right in self.exceptions:
                    continue
            total += weight
        return total, words

    def score(self, total: float, words: int) -> float:
        b, w, n = self.coefficients
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, b + w * math.log1p(total) + n * math.log1p(max(words, 0))))))


def _counted(rows: DataFrame) -> DataFrame:
    """(feature, n): in how many texts it stands."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for (text,) in rows_of(batches):
            found.update(features(fold(text)))
            if len(found) > 500_000:
                yield pa.RecordBatch.from_pydict({"f": list(found), "n": list(found.values())})
                found.clear()
        if found:
            yield pa.RecordBatch.from_pydict({"f": list(found), "n": list(found.values())})

    return rows.select("t").mapInArrow(lean(run), "f string, n long").groupBy("f").agg(F.sum("n").alias("n"))


def learn_lexicon(toxic: list[tuple[int, ...]], names: list[str], positive: np.ndarray, negative: np.ndarray, n_toxic: int, n_clean: int) -> dict[str, float]:
    """Greedy cover: the entry that is in most toxic texts without COVER entries so far comes next.

    So words that only copies of one toxic text share don't get in: the true entries have covered those texts.
    """
    weight = np.log((positive + 0.5) / (n_toxic + 1)) - np.log((negative + 0.5) / (n_clean + 1))
    where: dict[int, list[int]] = {}
    for t, f in enumerate(toxic):
        for x in f:
            where.setdefault(x, []).append(t)
    covered = [set() for _ in toxic]  # words that the entries so far have hit, by text
    gain = {x: len(ts) for x, ts in where.items()}
    chosen: dict[str, float] = {}
    while gain:
        most = max(gain.values())
        if most < MIN_TEXTS:
            break
        # Of entries that gain about as much, the longest stem is the most specific.
        x = max((x for x, g in gain.items() if g >= 0.99 * most), key=lambda x: (len(names[x].rstrip()), weight[x], names[x]))
        del gain[x]
        chosen[names[x]] = float(weight[x])
        stem = names[x].rstrip()
        for t in where[x]:
            full = len(covered[t]) >= COVER
            covered[t].add(stem)
            if len(covered[t]) >= COVER and not full:
                for y in toxic[t]:
                    if y in gain:
                        gain[y] -= 1
        # What begins with it adds no hit, and its own beginnings only add words of other texts, if of any.
        for y in [y for y in gain if names[y].startswith(stem) or stem.startswith(names[y].rstrip()) and len(where[y]) <= len(where[x])]:
            del gain[y]
    return chosen


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton steps; the classes weigh alike."""
    x = np.hstack([np.ones((len(x), 1)), x])
    sizes = np.bincount(y.astype(int), minlength=2)
    if min(sizes) == 0:
        return (-4.0, 0.0, 0.0) if sizes[1] == 0 else (4.0, 0.0, 0.0)
    w = np.where(y > 0, len(y) / 2 / sizes[1], len(y) / 2 / sizes[0])
    beta, penalty = np.zeros(3), np.diag([1e-6, ridge, ridge]) * 20
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (w * (p - y)) + penalty @ beta
        hess = (x * (w * p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(3)
        step = np.linalg.solve(hess, grad)
        beta -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """A model from docs joined with labels (id_col, label_col of 0 or 1); null labels and ids are passed over.

    The caller takes held-out rows away. Without toxic rows every score is low; without clean ones, high.
    """
    spark = docs.sparkSession
    marked = labels.select(F.col(id_col).alias("k"), F.col(label_col).cast("int").alias("y")).where("k IS NOT NULL AND y IN (0, 1)")
    sizes = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two rows at most
    picked = F.lit(False)
    for y, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN)):
        share = min(1.0, most / max(1, sizes.get(y, 0)))
        picked = picked | ((F.col("y") == y) & (F.pmod(F.xxhash64(F.lit(11), "k"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))))
    sample = staged(docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).join(F.broadcast(marked.where(picked)), "k").select("t", "y").distinct())
    toxic, clean = sample.where("y = 1"), sample.where("y = 0")
    n_toxic, n_clean = toxic.count(), clean.count()
    # Bounded by the sample: features of three of its toxic texts that are rare in its clean ones.
    both = _counted(toxic).where(F.col("n") >= MIN_TEXTS).join(_counted(clean).withColumnRenamed("n", "m"), "f", "left").select("f", "n", F.coalesce("m", F.lit(0)).alias("m"))
    rate = F.col("n") / F.lit(max(1, n_toxic))
    good = sorted(((r["f"], r["n"], r["m"]) for r in both.where(rate >= F.lit(MIN_PRECISION) * (rate + F.col("m") / F.lit(max(1, n_clean)))).collect()), key=lambda g: (-g[1], g[0]))
    names = [g[0] for g in good]
    place = spark.sparkContext.broadcast({f: i for i, f in enumerate(names)})

    def incidence(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = place.value
            out = [[at[f] for f in sorted(features(fold(t))) if f in at] for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int32()))], ["x"])

    rows = [tuple(r["x"]) for r in toxic.select("t").mapInArrow(lean(incidence), "x array<int>").collect()]  # bounded by SAMPLE_TOXIC
    lexicon = learn_lexicon(sorted(rows), names, np.array([g[1] for g in good], float), np.array([g[2] for g in good], float), n_toxic, n_clean)
    model = ToxicityModel(lexicon)
    model.exceptions = _exceptions(sample, model)
    weighed = [(r["w"], r["n"], r["y"]) for r in _weighed(sample, model, "y").collect()]  # bounded by the sample
    if weighed:
        a = np.array(sorted(weighed), float)
        model.coefficients = fit(np.log1p(a[:, :2]), a[:, 2])
    return model


def _exceptions(sample: DataFrame, model: ToxicityModel) -> frozenset[str]:
    """Pairs of a word hit and its neighbour that at least two clean texts and no toxic text of the sample have."""
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for text, y in rows_of(batches):
            own: Counter = Counter()
            shared.value.weigh(fold(text), own)
            found.update((p, y) for p in own)
        yield pa.RecordBatch.from_pydict({"p": [p for p, _ in found], "y": [y for _, y in found], "n": list(found.values())}, pa.schema([("p", pa.string()), ("y", pa.int32()), ("n", pa.int64())]))

    by = sample.select("t", "y").mapInArrow(lean(run), "p string, y int, n long").groupBy("p").agg(F.sum(F.expr("IF(y = 0, n, 0)")).alias("c"), F.sum(F.expr("IF(y = 1, n, 0)")).alias("x"))
    return frozenset(r["p"] for r in by.where("c >= 2 AND x = 0").collect())  # bounded by the hits in the sample's clean texts


def _weighed(rows: DataFrame, model: ToxicityModel, key: str) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                got = [m.weigh(fold(t)) for t in part.column(1).to_pylist()]
                score = [m.score(*g) for g in got]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.int64()), pa.array(score, pa.float64())], [key, "w", "n", "score"])

    return rows.select(key, "t").mapInArrow(lean(run), f"`{key}` {kind}, w double, n long, score double")


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score) for every row; null and empty texts are scored as texts without words.

    Ids may repeat or be null; other columns aren't read. Texts are scored as a whole, however long.
    """
    return _weighed(docs.select(F.col(id_col), F.col(text_col).alias("t")), model, id_col).select(id_col, "score")


def rejected(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """docs without the rows whose score reaches the threshold; columns, order of columns and other rows stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                yield part.filter(pa.array([m.score(*m.weigh(fold(t))) < threshold for t in part.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
