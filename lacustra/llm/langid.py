"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts become code points, lower-cased, with every run of what isn't a letter as a space. All n-grams of one to
three characters are hashed into a fixed number of slots. Training sums counts by language over every labelled
row: dense partial counts per task, summed in two levels, so that no task gets more than about the root of the
number of partitions of them. The log-probability matrix has a fixed number of slots and a bounded number of
languages; it is broadcast, and batches of texts are scored in numpy by gathering and summing its rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, mixed, rows_of, sliced

SLOTS = 1 << 16
ORDERS = (1, 2, 3)
#: The matrix that is broadcast has at most SLOTS * MAX_LANGUAGES * 4 bytes.
MAX_LANGUAGES = 256
SMOOTHING = 0.5
PAD = "   "
CHUNK_CHARS = 1 << 18


def _letters() -> np.ndarray:
    """What each code point counts as: itself if a letter, else a space."""
    table = np.full(0x110000, 32, np.uint32)
    letter = np.fromiter((chr(c).isalpha() for c in range(len(table))), bool, len(table))
    table[letter] = np.flatnonzero(letter)
    return table


_TABLE: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    if not _TABLE:
        _TABLE.append(_letters())
    return _TABLE[0]


def grams(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Slots of the n-grams by order (-1 where a gram is blank), the starts of the texts in them, and letters by text."""
    bounds = np.cumsum([0, *(len(t) + len(PAD) for t in texts)])
    points = np.frombuffer((PAD.join(texts) + PAD).encode("utf-32-le", "surrogatepass"), np.uint32)
    points = letter_table()[points]
    letter = points != 32
    letters = np.add.reduceat(letter.astype(np.int64), bounds[:-1]) if texts else np.zeros(0, np.int64)
    wide = points.astype(np.uint64)
    out = []
    with np.errstate(over="ignore"):
        value, seen = np.zeros(len(wide), np.uint64), np.zeros(len(wide), bool)
        for n in range(1, max(ORDERS) + 1):
            shifted = np.full(len(wide), 32, np.uint64)
            shifted[: len(wide) - n + 1] = wide[n - 1 :]
            value = value * np.uint64(0x110000) + shifted
            seen = seen | (shifted != 32)
            if n in ORDERS:
                slot = (mixed(value + np.uint64(n << 60)) % np.uint64(SLOTS)).astype(np.int64)
                slot[~seen] = -1
                out.append(slot)
    return out, bounds[:-1], letters


@dataclass
class LanguageModel:
    languages: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray  # languages x (slots + 1); the last column is 0, for blank grams

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """The likeliest language of each text and its posterior probability; `und` and 0 without any letter."""
        if not texts:
            return [], []
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts)
        slots, starts, letters = grams(texts)
        total = np.tile(self.log_prior[:, None], (1, len(texts)))
        for i, row in enumerate(self.log_prob):
            for s in slots:
                total[i] += np.add.reduceat(row[s].astype(np.float64), starts)
        best = total.argmax(0)
        score = 1 / np.exp(total - total.max(0)).sum(0)
        names = [self.languages[b] if k else "und" for b, k in zip(best, letters, strict=True)]
        return names, [float(s) if k else 0.0 for s, k in zip(score, letters, strict=True)]


def lowered(text: str | None) -> str:
    return (text or "").lower()


def train(rows: DataFrame, text_col: str = "text", label_col: str = "lang") -> LanguageModel:
    """A model from every row whose text and label aren't null. More than MAX_LANGUAGES labels raise ValueError.

    An empty table gives a model that answers `und`. Languages are in alphabetical order, so ties go to the first.
    """
    rows = rows.select(F.col(text_col).alias("t"), F.col(label_col).cast("string").alias("l")).where("t IS NOT NULL AND l IS NOT NULL")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for part in sliced(rows_of(batches), lambda r: len(r[0]) + 64, CHUNK_CHARS):
            by: dict[str, list[str]] = {}
            for text, lang in part:
                by.setdefault(lang, []).append(lowered(text))
            for lang, texts in by.items():
                held = sums.setdefault(lang, np.zeros(SLOTS + 1, np.int64))
                for s in grams(texts)[0]:
                    held[:SLOTS] += np.bincount(s[s >= 0], minlength=SLOTS)
                held[SLOTS] += len(texts)
            if len(sums) > MAX_LANGUAGES:
                raise ValueError(f"more than {MAX_LANGUAGES} languages")
        yield pa.RecordBatch.from_pydict({"l": list(sums), "c": [v.tobytes() for v in sums.values()]}, pa.schema([("l", pa.string()), ("c", pa.binary())]))

    def total(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for lang, counts in rows_of(batches):
            held = sums.setdefault(lang, np.zeros(SLOTS + 1, np.int64))
            held += np.frombuffer(counts, np.int64)
        yield pa.RecordBatch.from_pydict({"l": list(sums), "c": [v.tobytes() for v in sums.values()]}, pa.schema([("l", pa.string()), ("c", pa.binary())]))

    partial = rows.mapInArrow(lean(count), "l string, c binary").withColumn("g", F.spark_partition_id())
    groups = max(1, round(rows.rdd.getNumPartitions() ** 0.5))
    partial = partial.repartition(groups, F.pmod("g", F.lit(groups))).select("l", "c").mapInArrow(lean(total), "l string, c binary")
    summed = partial.repartition(max(1, min(groups, 32)), "l").mapInArrow(lean(total), "l string, c binary").collect()  # a row of SLOTS counts for each language
    if len(summed) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    found = sorted((r["l"], np.frombuffer(bytes(r["c"]), np.int64)) for r in summed) if len({r["l"] for r in summed}) == len(summed) else []
    languages = [x for x, _ in found]
    if not languages:
        return LanguageModel([], np.zeros(0), np.zeros((0, SLOTS + 1), np.float32))
    counts = np.array([c[:SLOTS] for _, c in found], np.float64) + SMOOTHING
    docs = np.array([c[SLOTS] for _, c in found], np.float64)
    prob = np.log(counts / counts.sum(1, keepdims=True))
    return LanguageModel(languages, np.log(docs / docs.sum()), np.hstack([prob, np.zeros((len(languages), 1))]).astype(np.float32))


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score) for every row: whole texts; null, empty or letterless ones give `und` and 0.

    Ids may repeat or be null; other columns aren't read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                names: list[str] = []
                scores: list[float] = []
                for held in sliced(((lowered(t),) for t in part.column(1).to_pylist()), lambda r: len(r[0]) + 64, CHUNK_CHARS):
                    n, s = shared.value.predict([t for (t,) in held])
                    names += n
                    scores += s
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], [id_col, "lang_pred", "score"])

    return docs.select(id_col, text_col).mapInArrow(lean(run), f"`{id_col}` {kind}, lang_pred string, score double")


def held_out(id_col: Column, folds: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id counts as the text `null`."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("null"))) % F.lit(folds) == F.lit(remainder)
