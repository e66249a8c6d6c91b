"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Labels are learned only from rows whose crc32(key as text) mod 3 is not 1, and from MAX_LABELLED of those at most (those
with the smallest hashes of their keys, so the bound is no prefix of the table). The lexicon of words and word
beginnings that mark toxic texts is counted on three folds of those rows; its densities, the nearness of second-person
words, capitals, punctuation and obfuscation make the features of the trees, which learn from the same folds, each with
the lexicon of the other two, so that they see it as new texts do. The fourth fold, kept from lexicon and trees, calibrates their score.
Scoring has no shuffle. The key, labels, language and source are never inputs of a score.

Defined cases: null and empty texts have zero features and get a score as others do; where the labels at hand have one
class only, or those of the trees' folds, or where there is none, the score is the share of label 1 (0 without labels); where the
calibration's fold has one class or no row, the score is that of the trees alone; repeated rows are scored each; an empty table gives an empty result; further
columns, such as score or held_out, are ignored.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, functions as F

from sparkloom.llm import _text as tx
from sparkloom.llm._shared import Scratch

MAX_LABELLED = 12_000
MIN_Z = 5.0
BEGINNINGS = (4, 5, 6, 7)
NEAR = 5
THRESHOLD = 0.7
#: The fold, of four, that calibrates.
CALIBRATION = 3

# Second-person words of the languages served, and signs that stand for letters.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine euch euer ihr tu te toi ton ta tes vous votre vos tú ti usted ustedes tus vosotros".split())
_FOR_LETTERS = str.maketrans("013457@$!|", "oieastasil")

_WORD = re.compile(r"[^\W\d_]+")
_ODD = re.compile(r"[^\W\d_]+[0-9@$*!|.\-]+[^\W\d_]+")
_NOT_LETTER = re.compile(r"[^\w]|[\d_]")
_LONG_RUN = re.compile(r"(\w)\1\1")

FEATURES = ("words", "beginnings", "count", "hidden", "second", "near", "capitals", "marks", "odd", "runs", "symbols", "length")
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!?")] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>@^~_=+")] = True


def fold(key: Column) -> Column:
    """crc32 of the key as text; mod 3 equal to 1 marks the rows kept from all learning."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))


@dataclass(frozen=True)
class Lexicon:
    words: frozenset[str]
    beginnings: frozenset[str]


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    constant: float


def labelled_rows(docs: DataFrame, labels: DataFrame, key: str, text: str, limit: int) -> DataFrame:
    """_fold, _text, _toxic of the rows to learn from; limit bounds what is joined to the documents by broadcast."""
    chosen = (
        labels.select(F.col(key).alias("_id"), F.col("toxic").cast("double").alias("_toxic"))
        .where(F.col("_toxic").isNotNull() & F.col("_id").isNotNull() & (fold(F.col("_id")) % 3 != 1))
        .groupBy("_id")
        .agg(F.max("_toxic").alias("_toxic"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(limit)
    )
    rows = docs.select(F.col(key).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return rows.join(F.broadcast(chosen), "_id").select((F.floor(fold(F.col("_id")) / 3) % 4).alias("_fold"), "_text", "_toxic")


def learn_lexicon(rows: DataFrame) -> Lexicon:
    """Words and beginnings of words that occur in a larger share of toxic texts, by a z test of the two shares.

    rows are bounded by what learn() takes, and so is the lexicon that the driver gets.
    """
    n = {r["_toxic"]: r["n"] for r in rows.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = n.get(1.0, 0), n.get(0.0, 0)
    if not bad or not good:
        return Lexicon(frozenset(), frozenset())
    words = F.array_distinct(F.regexp_extract_all(F.lower("_text"), F.lit(r"(\p{L}+)"), 1))

    def cut(k: int) -> Column:
        return F.transform(F.filter("w", lambda w: F.length(w) > k), lambda w: F.concat(F.substring(w, 1, k), F.lit("-")))

    units = F.array_distinct(F.concat("w", *map(cut, BEGINNINGS)))
    counts = rows.select("_toxic", words.alias("w")).select("_toxic", F.explode(units).alias("unit")).groupBy("unit").agg(F.sum("_toxic").alias("t"), F.count("*").alias("n"))
    p = F.col("n") / (bad + good)
    z = (F.col("t") / bad - (F.col("n") - F.col("t")) / good) / F.sqrt(p * (1 - p) * (1 / bad + 1 / good))
    lift = (F.col("t") / bad) / ((F.col("n") - F.col("t") + 1) / good)
    top = counts.where((F.col("t") >= 3) & (F.col("n") < bad + good)).where((z >= MIN_Z) & (lift >= 4)).select("unit").collect()
    found = [r["unit"] for r in top]
    return Lexicon(frozenset(u for u in found if u[-1] != "-"), frozenset(u[:-1] for u in found if u[-1] == "-"))


def _has(word: str, lexicon: Lexicon) -> int:
    return (word in lexicon.words) | 2 * any(word[:k] in lexicon.beginnings for k in BEGINNINGS if len(word) > k)


def slice_features(texts: list[str], data: np.ndarray, offsets: np.ndarray, lexicon: Lexicon, known: dict[str, int]) -> np.ndarray:
    """One row of FEATURES for each text. known keeps what the lexicon says of words seen before."""
    out = np.zeros((len(texts), len(FEATURES)))
    letters = np.maximum(tx.per_text_sum(_LETTER[data], offsets), 1)
    size = np.maximum(np.diff(offsets), 1)
    out[:, 6] = tx.per_text_sum(_UPPER[data], offsets) / letters
    out[:, 7] = tx.per_text_sum(_MARK[data], offsets) / size
    out[:, 10] = tx.per_text_sum(_SYMBOL[data], offsets) / size
    for i, text in enumerate(texts):
        low = text.lower()
        words = _WORD.findall(low)
        n = max(1, len(words))
        for w in set(words).difference(known):
            known[w] = _has(w, lexicon)
        kinds = [known[w] for w in words]
        hits = [j for j, k in enumerate(kinds) if k]
        second = [j for j, w in enumerate(words) if w in SECOND_PERSON]
        odd = _ODD.findall(low) if any(c in low for c in "013457@$*!|") else []
        hidden = sum(bool(_has(x, lexicon)) for w in odd for x in {_NOT_LETTER.sub("", w.translate(_FOR_LETTERS)), _NOT_LETTER.sub("", w)})
        near = 0
        if hits and second:
            at = np.array(second)
            right = np.searchsorted(at, hits)
            gap = np.minimum(np.abs(at[np.minimum(right, len(at) - 1)] - hits), np.abs(at[np.maximum(right - 1, 0)] - hits))
            near = int((gap <= NEAR).sum())
        out[i, 0] = sum(k & 1 for k in kinds) / n
        out[i, 1] = sum(k >> 1 for k in kinds) / n
        out[i, 2] = np.log1p(len(hits))
        out[i, 3] = hidden / n
        out[i, 4] = len(second) / n
        out[i, 5] = near / n
        out[i, 8] = len(odd) / n
        out[i, 9] = len(_LONG_RUN.findall(low)) / n
        out[i, 11] = np.log1p(len(words))
    if len(known) > 500_000:
        known.clear()
    return out


def with_features(rows: DataFrame, lexicon: Lexicon, text: str) -> DataFrame:
    """rows without text, with _features array<double>."""
    kept = [f for f in rows.schema.fields if f.name != text]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", `_features` array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            for part in tx.slices(batch, text):
                values = slice_features([t or "" for t in part.column(text).to_pylist()], *tx.text_bytes(part.column(text)), lexicon, known)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * len(FEATURES), pa.int32()), pa.array(values.ravel()))
                names = [f.name for f in kept]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), lists], names=[*names, "_features"])

    return rows.mapInArrow(run, schema)


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", max_labelled: int = MAX_LABELLED, seed: int = 7) -> Model:
    with Scratch(docs.sparkSession) as store:
        rows = store.table(labelled_rows(docs, labels, key, text, max_labelled), "labelled")
        lexicon = learn_lexicon(rows.where(F.col("_fold") != CALIBRATION))
        parts = [with_features(rows.where(F.col("_fold") == CALIBRATION), lexicon, "_text")]
        for fold_ in (f for f in range(4) if f != CALIBRATION):
            others = learn_lexicon(rows.where(~F.col("_fold").isin(fold_, CALIBRATION)))
            parts.append(with_features(rows.where(F.col("_fold") == fold_), others, "_text"))
        points = store.table(functools.reduce(DataFrame.unionByName, parts), "points").withColumn("features", array_to_vector("_features"))
        shares = points.agg(F.avg("_toxic").alias("share"), F.max(F.when(F.col("_fold") == CALIBRATION, F.col("_toxic"))).alias("top"), F.min(F.when(F.col("_fold") == CALIBRATION, F.col("_toxic"))).alias("low"), F.max(F.when(F.col("_fold") != CALIBRATION, F.col("_toxic"))).alias("top_trees"), F.min(F.when(F.col("_fold") != CALIBRATION, F.col("_toxic"))).alias("low_trees")).first()
        if shares["share"] in (None, 0.0, 1.0) or shares["top_trees"] == shares["low_trees"]:
            return Model(lexicon, None, None, shares["share"] or 0.0)
        trees = GBTClassifier(labelCol="_toxic", featuresCol="features", maxIter=20, maxDepth=4, stepSize=0.2, maxBins=64, minInstancesPerNode=5, seed=seed).fit(points.where(F.col("_fold") != CALIBRATION).coalesce(4))
        if shares["top"] is None or shares["top"] == shares["low"]:
            return Model(lexicon, trees, None, 0.0)
        judged = trees.transform(points.where(F.col("_fold") == CALIBRATION)).select("_toxic", _chance().alias("_chance"))
        return Model(lexicon, trees, IsotonicRegression(labelCol="_toxic", featuresCol="_chance").fit(judged), 0.0)


def _chance() -> Column:
    return vector_to_array("probability")[1]


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score and predicted for every row of docs."""
    rows = with_features(docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")), model.lexicon, "_text")
    value: Column = F.lit(float(model.constant))
    if model.trees is not None:
        rows = model.trees.transform(rows.withColumn("features", array_to_vector("_features"))).withColumn("_chance", _chance())
        value = F.col("_chance")
        if model.calibration is not None:
            rows = model.calibration.setPredictionCol("_calibrated").transform(rows.drop("prediction"))
            # The steps of the calibration hold many scores; a little of the trees' own order stays within a step.
            value = F.col("_calibrated") * 0.999 + F.col("_chance") * 0.001
    return rows.select(
        F.col("_id").alias(key), (fold(F.col("_id")) % 3 == 1).alias("held_out"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)).alias("score")
    ).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
