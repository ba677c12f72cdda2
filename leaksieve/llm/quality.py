"""Text quality by compression: which class's dictionary makes a text smaller.

A zstandard dictionary is trained from good and one from bad labelled text.
Every piece of a text is compressed with both; the difference of the summed
sizes over their sum is turned into a probability by a logistic curve, fitted on
labelled texts that the dictionaries have not seen and weighted to the labels'
own proportion.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Sent
from .words import packed

#: Labelled rows of each class, and characters of each, that are fitted on at most.
SAMPLE_ROWS = 1500
SAMPLE_CHARS = 32_768
DICTIONARY_BYTES = 112_640
#: A text is compressed in pieces, so that the dictionary counts for its end as for its start.
PIECE = 4096
LEVEL = 3
FEATURES = 4
#: Log of the bytes of text per two compressed bytes from which a text counts as repeating itself.
REPETITIVE = 0.7
#: Bytes of text at which the size difference counts for half: that of a few words is chance.
FAINT = 128


def _dictionary(texts: Sequence[bytes]) -> bytes:
    pieces = [t[i : i + PIECE] for t in texts for i in range(0, len(t), PIECE)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too little text: it is the dictionary itself
        return b"".join(texts)[-DICTIONARY_BYTES:]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    weights: tuple[float, ...] = (0.0,) * FEATURES

    def features(self, data: memoryview, ends: np.ndarray) -> np.ndarray:
        """A constant, the normalised size difference, that weighted by how much text there is, and how far the text repeats itself."""
        compressors = [_compressor(self.good), _compressor(self.bad)]
        out = np.zeros((len(ends) - 1, FEATURES))
        out[:, 0] = 1.0
        for row, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
            if a == b:
                continue
            pieces = [data[i : min(b, i + PIECE)] for i in range(a, b, PIECE)]
            good, bad = (sum(len(c.compress(p)) for p in pieces) for c in compressors)
            x = (bad - good) / (bad + good) * (b - a) / (b - a + FAINT)
            out[row, 1:] = x, x * min(1.0, (b - a) / PIECE), max(0.0, np.log((b - a) / (good + bad)) - REPETITIVE)
        return out

    def scores(self, data: memoryview, ends: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(data, ends) @ np.array(self.weights), -500, 500)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple[float, ...]:
    """Weighted logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (weight * (y - p)) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(w.tolist())


def joined(texts: Sequence[bytes]) -> tuple[memoryview, np.ndarray]:
    return memoryview(b"".join(texts)), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def learnable(id_column: str = "doc_id") -> Column:
    """Rows whose labels may be learned from; a null id is held out."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % 5 != 0


def fit_quality(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> QualityModel:
    """A model from at most ``SAMPLE_ROWS`` labelled rows of each class, chosen by a hash of their id.

    Only rows that are not held out count. Every other row of the sample trains
    the dictionaries, the rest the curve. With a class missing, or no labels
    at all, every text scores the share of good labels (one half without any).
    """
    known = labels.filter(F.col(label_column).isin(0, 1) & learnable(id_column)).select(id_column, F.col(label_column).alias("__label")).distinct()
    share = {row["__label"]: row["count"] for row in known.groupBy("__label").count().collect()}
    picked = [
        known.filter(F.col("__label") == label).orderBy(F.xxhash64(id_column, F.lit(10)), id_column).limit(SAMPLE_ROWS) for label in (0, 1)
    ]
    chosen = F.broadcast(picked[0].unionAll(picked[1]))  # bounded by the limits
    start = F.pmod(F.xxhash64(id_column), F.greatest(F.lit(1), F.length(text_column) - SAMPLE_CHARS + 1)).cast("int") + 1
    piece = F.substring(F.col(text_column).cast("string"), start, F.lit(SAMPLE_CHARS)).alias("__piece")
    rows = docs.join(chosen, id_column).select(id_column, "__label", piece).filter("__piece <> ''").toPandas()
    rows = rows.sort_values([id_column, "__label", "__piece"])
    texts: dict[int, list[bytes]] = {label: [t.encode() for t in rows["__piece"][rows["__label"] == label]] for label in (0, 1)}
    total = sum(share.values())
    prior = (share.get(1, 0) + 1) / (total + 2) if total else 0.5
    if min(len(t) for t in texts.values()) < 2:
        return QualityModel(b"", b"", (float(np.log(prior / (1 - prior))), *[0.0] * (FEATURES - 1)))
    model = QualityModel(_dictionary(texts[1][::2]), _dictionary(texts[0][::2]))
    fresh = {label: texts[label][1::2] for label in (0, 1)}
    x = np.concatenate([model.features(*joined(fresh[label])) for label in (0, 1)])
    y = np.repeat([0.0, 1.0], [len(fresh[0]), len(fresh[1])])
    weight = np.where(y == 1, share[1] / len(fresh[1]), share[0] / len(fresh[0]))
    model.weights = _logistic(x, y, weight * len(y) / weight.sum())
    return model


def quality_score(model: QualityModel, text: Column, spark) -> Column:
    """The probability that a text is good, for every text; null counts as empty."""
    sent = Sent(spark, model)

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        data, ends = packed(column)
        return pa.array(sent.value.scores(memoryview(data), ends))

    return score(text.cast("string"))


def score_quality(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", cut: float = 0.3) -> DataFrame:
    """Per row its id, whether it is held out, its score, and 1 where the score reaches ``cut``.

    Every row returns, equal rows as often as they come; null and empty texts
    get the score of a text that says nothing either way. Inputs of the score
    are the bytes of the text alone.
    """
    model = fit_quality(docs, labels, id_column, text_column)
    scored = docs.select(F.col(id_column), (~learnable(id_column)).alias("held_out"), quality_score(model, F.col(text_column), docs.sparkSession).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))
