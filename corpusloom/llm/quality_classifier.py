"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class gets a mean and a covariance, shrunk towards the pooled one and a diagonal; a document's
score is the logistic of the difference of its two log densities, from Mahalanobis distances by
cached Cholesky factors. Means and covariances come from sums over all training rows, added up
where the rows are; the driver sees two rows of sums.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import crc_of, materialize, named, table

FEATURES = (
    "log_words", "word_length", "upper_share", "symbol_share", "digit_share", "punctuation_share", "letter_share",
    "distinct_words", "distinct_windows", "line_length", "distinct_lines", "shouting",
)
#: Weight of the pooled covariance in each class's, and of the diagonal in the result.
SHRINK_POOLED = 0.1
SHRINK_DIAGONAL = 0.02
#: Log-density differences are divided by this before the logistic: statistics are not quite normal.
TEMPERATURE = 4.0
#: Predicted 1 from this score on.
THRESHOLD = 0.3
FOLDS = 5

_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LOWER = (_BYTES >= 97) & (_BYTES <= 122)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_HIGH = _BYTES >= 128
_STOPS = np.isin(_BYTES, list(b".,;:?'\"()-"))
_SPACE = np.isin(_BYTES, list(b" \t\n\x0b\x0c\r"))
_SYMBOL = ~(_UPPER | _LOWER | _DIGIT | _HIGH | _STOPS | _SPACE)
_KINDS = np.stack([_UPPER, _LOWER, _DIGIT, _HIGH, _STOPS, _SPACE, _SYMBOL]).astype(float)


def statistics(text: str | None) -> np.ndarray:
    """The transformed statistics of a whole text; a null or empty text has those of no words."""
    data = (text or "").encode("utf-8", "replace")
    words = data.split()
    n = len(words)
    upper, lower, digit, high, stops, space, symbol = _KINDS @ np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    solid = max(1.0, len(data) - space)
    lines = [x for x in data.split(b"\n") if x.strip()]
    windows = max(0, n - 2)
    share = lambda x, of: np.sqrt(x / of)
    return np.array([
        np.log1p(n), np.log(solid / max(1, n)), share(upper, max(1.0, upper + lower)), share(symbol, solid), share(digit, solid), share(stops, solid),
        share(upper + lower + high, solid), (len(set(words)) + 1) / (n + 1) * np.log1p(np.log1p(n)), (len(set(zip(words, words[1:], words[2:]))) + 20) / (windows + 20),
        np.log1p(len(data) / max(1, len(lines))), (len(set(lines)) + 3) / (len(lines) + 3), share(data.count(b"!"), max(1, n)),
    ])


def with_statistics(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id and x, the array of its text's statistics."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(t.as_py()) for t in batch.column(1)]
            flat = pa.array(np.concatenate(found) if found else np.zeros(0))
            ends = pa.array(np.arange(len(found) + 1, dtype=np.int32) * len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, flat)], names=["doc_id", "x"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(each, f"doc_id {kind}, x array<double>")


@dataclass
class Discriminant:
    means: np.ndarray  # (2, d)
    halves: np.ndarray  # inverses of the Cholesky factors
    logs: np.ndarray  # log prior less half the log determinant
    temperature: float = TEMPERATURE

    def scores(self, x: np.ndarray) -> np.ndarray:
        density = [c - 0.5 * (((x - m) @ h.T) ** 2).sum(1) for m, h, c in zip(self.means, self.halves, self.logs, strict=True)]
        return 1 / (1 + np.exp(-np.clip((density[1] - density[0]) / self.temperature, -500, 500)))


def fit(rows: DataFrame, pooled: float = SHRINK_POOLED, diagonal: float = SHRINK_DIAGONAL, temperature: float = TEMPERATURE) -> Discriminant:
    """rows: x and label (0 or 1); others are left out. A class without rows takes the other's place
    with a wide covariance; without any rows every score is a half."""
    d = len(FEATURES)
    cells = [F.sum(F.get("x", F.lit(i)) * F.get("x", F.lit(j))).alias(f"p{i}_{j}") for i in range(d) for j in range(i + 1)]
    sums = rows.where("label in (0, 1)").groupBy("label").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.get("x", F.lit(i))).alias(f"s{i}") for i in range(d)], *cells).collect()
    n, means, scatter = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for r in sums:
        k = int(r["label"])
        n[k], means[k] = r["n"], [r[f"s{i}"] / r["n"] for i in range(d)]
        full = np.array([[r[f"p{max(i, j)}_{min(i, j)}"] for j in range(d)] for i in range(d)])
        scatter[k] = full - r["n"] * np.outer(means[k], means[k])
    if n.sum() == 0:
        return Discriminant(means, np.stack([np.eye(d)] * 2), np.zeros(2), temperature)
    common = scatter.sum(0) / max(1, n.sum() - 2)
    halves, logs = [], []
    for k in (0, 1):
        if n[k] == 0:
            means[k] = means[1 - k]
        own = scatter[k] / max(1, n[k] - 1)
        mixed = (1 - pooled) * own + pooled * common if n[k] > 1 else common * 4
        mixed = (1 - diagonal) * mixed + diagonal * np.diag(np.diag(common)) + 1e-6 * np.eye(d)
        factor = np.linalg.cholesky(mixed)
        halves.append(np.linalg.inv(factor))
        logs.append(np.log((n[k] + 1) / (n.sum() + 2)) - np.log(np.diag(factor)).sum())
    return Discriminant(means, np.stack(halves), np.array(logs), temperature)


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", folds: int = FOLDS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs.

    Labels are learnt from rows whose crc32(doc_id as text) mod folds is not 0. A document labelled
    more than once counts with its largest label; a null label or doc_id is not learnt from, but such
    a document is scored. A null or empty text has the statistics of no words; texts of any
    length are read whole. Repeated rows are scored alike; other columns are not looked at; an empty table gives an empty table.
    """
    stored = materialize(with_statistics(docs, doc_id, text), "statistics")
    held = (crc_of(F.col("doc_id")) % folds == 0).alias("held_out")
    known = labels.groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(label).alias("label"))
    model = fit(stored.where(~held).join(known, "doc_id"))

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.stack(x.to_numpy())) if len(x) else np.zeros(0))

    found = stored.select("doc_id", held, score("x").alias("score"))
    return found.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score threshold or more, learnt as classify() does; all columns, whatever their names, no
    shuffle of texts. A null or empty text is scored as one of no words; repeated rows share their fate; an empty table
    gives an empty one, and without labels all rows stay (every score is a half)."""
    known = labels.groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(label).alias("label"))
    learnt = docs.where(crc_of(F.col(doc_id)) % FOLDS != 0)
    model = fit(with_statistics(learnt, doc_id, text).join(known, "doc_id"))  # statistics are shuffled at most, no texts

    @F.pandas_udf("boolean")
    def good(t: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.stack([statistics(x) for x in t])) >= threshold if len(t) else np.zeros(0, bool))

    return docs.where(good(named(text)))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op2_quality_classifier": op2_quality_classifier}
ORACLES: dict[str, str] = {}
