"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is the average of the embeddings of its hashed character n-grams; a linear softmax reads the
language off it. Embeddings and softmax are trained together by stochastic gradient descent in
numpy on a bounded sample of whole documents; the documents of the sample that training does not see
calibrate the scores (a temperature) and the rejection threshold. Of a document the fit needs the
counts of its n-grams' buckets only, which are made where the text is: no text goes to the driver.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import crc_of, materialize, release, small, table

GRAMS = (1, 2, 3, 4)
BUCKETS = 1 << 16
DIMENSIONS = 16
FOLDS, HELD = 4, 2
#: The fit's sample: so many documents, languages balanced, each learnt from as a whole; fewer if their counts are more
#: than so many bytes, of which the driver holds them all: 6 for each different n-gram of a text.
SAMPLE_DOCS, SAMPLE_BYTES = 1500, 96 << 20
EPOCHS = 5
RATE = 1.0
#: Embeddings move by so much more, as each gets a small share of its text's gradient.
SPEED = 20
#: Of the calibration texts that are predicted right, this share may be rejected.
REJECT_RIGHT = 0.01
#: Characters scored at a time: a long text is summed up in blocks.
BLOCK = 1 << 20
UNDETERMINED = "und"

_ODD = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)]
#: ASCII other than letters separates words.
_PLAIN = np.array([c if chr(c).isalpha() else 32 for c in range(128)], np.uint32)


def has_letter(text: str | None) -> bool:
    """Whether a character of the text is a letter (Unicode categories L*); numbers such as \u00bd are none."""
    return bool(text) and any(map(str.isalpha, text))


def _grams(c: np.ndarray, context: int) -> list[np.ndarray]:
    """Buckets of the n-grams of code points that end after the first context ones."""
    out, h = [], np.zeros(len(c), np.uint32)
    for n in range(1, max(GRAMS) + 1):
        if len(c) < n:
            break
        h = (h[: len(c) - n + 1] ^ (h[: len(c) - n + 1] >> np.uint32(15))) * _ODD[0] + c[n - 1 :] * _ODD[1]
        if n in GRAMS:
            new = h[max(0, context - n + 1) :]
            out.append((new ^ (new >> np.uint32(13))) * _ODD[2] >> np.uint32(16))
    return out


def grams(text: str) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of a text's lower-cased code points, in blocks of a bounded size."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    c = np.concatenate([[np.uint32(32)], np.where(c < 128, _PLAIN[np.minimum(c, 127)], c), [np.uint32(32)]]).astype(np.uint32)
    back = max(GRAMS) - 1
    for i in range(0, len(c), BLOCK):
        lo = max(0, i - back)
        yield np.concatenate(_grams(c[lo : i + BLOCK], i - lo)).astype(np.int64)


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, how often) of a whole text: at most BUCKETS of each."""
    total = np.zeros(BUCKETS, np.int64)
    for block in grams(text):
        total += np.bincount(block, minlength=BUCKETS)
    some = np.nonzero(total)[0]
    return some, total[some]


@dataclass
class Model:
    languages: list[str]
    logits: np.ndarray  # (BUCKETS, languages): embeddings times softmax weights
    bias: np.ndarray
    temperature: float
    reject_below: float

    def mean_logits(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.languages)), 0
        for found in grams(text):
            total += self.logits[found].sum(0, dtype=np.float64)
            n += len(found)
        return total / max(1, n) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, calibrated score, and whether the score is too low to be relied on."""
        if not self.languages or not has_letter(text):
            return UNDETERMINED, 0.0, True
        p = softmax(self.mean_logits(text)[None] / self.temperature)[0]
        k = int(p.argmax())
        return self.languages[k], float(p[k]), bool(p[k] < self.reject_below)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(parts: list[tuple[np.ndarray, np.ndarray]], languages: list[str], groups: list[int] | None = None, seed: int = 7) -> Model:
    """parts are counted() texts. An eighth of the groups (equal texts are one group) is held back and
    calibrates: no text is on both sides."""
    names = sorted(set(languages))
    y = np.array([names.index(x) for x in languages])
    rng = np.random.default_rng(seed)
    groups = np.array(range(len(parts)) if groups is None else groups)
    distinct = rng.permutation(np.unique(groups))
    held = np.isin(groups, distinct[: len(distinct) // 8])
    hold, own = np.nonzero(held)[0], rng.permutation(np.nonzero(~held)[0])
    e = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    w, b = rng.normal(0, 0.3, (DIMENSIONS, len(names))).astype(np.float32), np.zeros(len(names), np.float32)
    batch, total = 32, EPOCHS * max(1, len(own))
    for epoch in range(EPOCHS):
        rng.shuffle(own)
        for i in range(0, len(own), batch):
            rows = own[i : i + batch]
            sizes = np.array([len(parts[r][0]) for r in rows])
            found = np.concatenate([parts[r][0] for r in rows])
            share = np.concatenate([parts[r][1] / parts[r][1].sum(dtype=np.float64) for r in rows]).astype(np.float32)
            h = np.add.reduceat(e[found] * share[:, None], np.concatenate([[0], np.cumsum(sizes)[:-1]]), 0)
            p = softmax(h @ w + b)
            p[np.arange(len(rows)), y[rows]] -= 1
            rate = RATE * (1 - (epoch * len(own) + i) / total)
            back = -rate * (p @ w.T)
            w -= rate / len(rows) * (h.T @ p)
            b -= rate / len(rows) * p.sum(0)
            # one sum for each bucket and dimension, as buckets repeat
            some, at = np.unique(found, return_inverse=True)
            spread = np.repeat(back, sizes, 0) * share[:, None]
            e[some] += SPEED * np.stack([np.bincount(at, spread[:, k], len(some)) for k in range(DIMENSIONS)], 1)
    model = Model(names, (e @ w).astype(np.float32), b.astype(np.float64), 1.0, 0.0)
    if len(hold):
        z = np.stack([parts[i][1].astype(np.float64) @ model.logits[parts[i][0]].astype(np.float64) / parts[i][1].sum(dtype=np.float64) + model.bias for i in hold])
        odd = 1 / (len(hold) + 2)  # a share of each label is held to be wrong, so that a separable sample gives no certainty

        def loss(t: float) -> float:
            logs = np.log(softmax(z / t) + 1e-12)
            return -((1 - odd) * logs[np.arange(len(hold)), y[hold]] + odd * logs.mean(1)).mean()

        model.temperature = float(min(np.geomspace(0.02, 5, 60), key=loss))
        p = softmax(z / model.temperature)
        right = p.max(1)[p.argmax(1) == y[hold]]
        model.reject_below = float(np.quantile(right, REJECT_RIGHT)) if len(right) else 0.0
    return model


def sample(docs: DataFrame, doc_id: str, text: str, lang: str) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[str], list[int]]:
    """The bounded sample of the learning folds, counted: SAMPLE_DOCS rows, or as many as SAMPLE_BYTES allow, those with the
    least hash times the count of their language; and a hash of each text."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}") & (crc_of(F.col(doc_id)) % FOLDS != HELD))
    rows = rows.select(F.col(doc_id).alias("id"), F.col(text).alias("t"), F.col(lang).cast("string").alias("_l"))
    counts = small(rows.groupBy(F.col("_l").alias("_c")).agg(F.count(F.lit(1)).alias("_n")), "languages")
    n_languages, most = counts.agg(F.count(F.lit(1)), F.coalesce(F.max("_n"), F.lit(0))).first()
    key = (F.crc32(F.concat(F.lit("lang"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary")) + 1) / F.lit(2.0**32) * F.col("_n")
    keyed = rows.join(counts, F.col("_l") == F.col("_c")).select(key.alias("_k"), "_l", F.xxhash64("t").alias("_h"), "t")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                some, n = counted(batch.column(3)[i].as_py())
                made = [pa.array([some.astype("<u2").tobytes()], pa.binary()), pa.array([n.astype("<u4").tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(i, 1) for c in range(3)], *made], names=["_k", "_l", "_h", "some", "n"])

    # keys are even from 0 to their language's count: a bound on them passes about as many rows of any corpus, so
    # that few are counted and sorted; it is raised until the sample is full or all rows pass
    bound, sizes, counted_rows = 1.3 * SAMPLE_DOCS / max(1, n_languages), [], None
    while n_languages:
        passed = keyed.where(F.col("_k") <= bound).mapInArrow(count, "_k double, _l string, _h long, some binary, n binary")
        counted_rows = materialize(passed, "language-counts")
        sizes = counted_rows.select("_k", "_h", (F.octet_length("some") + F.octet_length("n")).alias("bytes")).orderBy("_k", "_h").limit(SAMPLE_DOCS).collect()
        if len(sizes) == SAMPLE_DOCS or bound > most:
            break
        release(counted_rows)
        bound *= 16
    took = []
    if sizes:
        held = np.cumsum([r["bytes"] for r in sizes])
        n = max(1, int((held <= SAMPLE_BYTES).sum()))  # the least keys, as many as the bytes allow
        last = sizes[n - 1]
        within = (F.col("_k") < last["_k"]) | ((F.col("_k") == last["_k"]) & (F.col("_h") <= last["_h"]))
        took = counted_rows.where(within).orderBy("_k", "_h").limit(n).collect()
    # as they came: widened in a mini-batch only
    parts = [(np.frombuffer(r["some"], "<u2"), np.frombuffer(r["n"], "<u4")) for r in took]
    return parts, [r["_l"] for r in took], [r["_h"] for r in took]


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row of docs.

    Learns from rows with a language whose crc32(doc_id as text) mod 4 is not 2. A null text, or one
    without a letter, gets `und` with score 0, and so does every text if no row can be learnt from.
    rejected tells that the calibrated score is below the threshold; lang_pred stays what the model
    says. Repeated rows are predicted alike; other columns are not looked at; an empty table gives
    an empty table.
    """
    parts, languages, groups = sample(docs, doc_id, text, lang)
    model = train(parts, languages, groups) if parts else Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 1.0)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages floats
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            rows = [m.predict(t.as_py()) for t in batch.column(2)]
            made = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    held = (crc_of(F.col(doc_id)) % FOLDS == HELD).alias("held_out")
    return docs.select(F.col(doc_id), held, F.col(text)).mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


QUERIES = {"op6_language_id": op6_language_id}
ORACLES: dict[str, str] = {}
