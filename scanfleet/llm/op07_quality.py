"""Quality by compression against dictionaries of good and bad text.

A text is compressed with a zstandard raw-content dictionary of texts labelled good and with one of texts labelled bad. The
difference of the two sizes over their sum is the feature; a logistic curve, fitted on labelled texts that are in neither
dictionary and weighted to the classes' true shares, makes it a probability.

Both come from a bounded sample: at most ``per_class`` texts of each class, two thirds for the dictionaries (excerpts of ``excerpt_chars``,
shortened to one length where they don't fit ``size`` bytes a class or the other class has less) and the rest, whole, for the curve. A text labelled more than once counts as good if half of its labels or more do. Null and
empty texts have a difference of 0. Where a class has no text, every score is the share of good labels (0.5 without labels). Repeated
rows get equal scores; texts of any length are read whole. A column that already has the output's name is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import slices
from .compression import Dictionaries, dictionary, excerpt, sample
from .op04_language_id import fold
from .registry import query, table

LEVEL, CHUNK = 6, 1024
THRESHOLD = 0.7


@dataclass
class QualityModel:
    dictionaries: Dictionaries | None
    slope: float
    offset: float

    def difference(self, text: str | None) -> float:
        """From -1 to 1, higher for text more like the good."""
        if not text or self.dictionaries is None:
            return 0.0
        bad, good = self.dictionaries.sizes(text.encode())
        return (bad - good) / (bad + good)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([self.difference(t) for t in texts], dtype=np.float64)
        return 1 / (1 + np.exp(-np.clip(self.slope * x + self.offset, -700, 700)))


def fit_curve(x: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton steps; classes are weighted to a ``share`` of good ones. A weak pull to 0
    keeps the slope finite where the classes don't overlap."""
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    scale = x.std() or 1.0
    z = np.column_stack([x / scale, np.ones(len(x))])
    pull = np.array([1e-2, 0.0])
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        hessian = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(pull + 1e-9)
        step = np.linalg.solve(hessian, z.T @ (weight * (y - p)) - pull * b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(b[0] / scale), float(b[1])


def train(docs: DataFrame, labels: DataFrame, per_class: int = 2400, excerpt_chars: int = 800, size: int = 300_000) -> QualityModel:
    """A model from doc_id and text, and doc_id and quality."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("good"))
    counts = {r["good"]: r["count"] for r in known.groupBy("good").count().collect()}
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.5
    if len(counts) == 2:
        # at most twice per_class ids, so this side is small whatever the corpus is
        few = F.broadcast(sample(known, "good", counts, per_class, F.col("doc_id")).select("doc_id", "good"))
        rows = docs.where(F.length("text") > 0).join(few, "doc_id").select("doc_id", "good", "text")
        role = F.pmod(F.xxhash64(F.lit("role"), F.col("text")), F.lit(3))
        told = rows.select("good", F.xxhash64("text").alias("hash"), F.when(role < 2, excerpt(F.col("text"), excerpt_chars)).alias("part"), F.when(role == 2, F.col("text")).alias("text"))
        # a repeated id brings its rows along; per class and part, only so many come to the driver
        kept = [told.where((F.col("good") == g) & F.col(c).isNotNull()).orderBy("hash", c).select(c).limit(per_class) for g in (0, 1) for c in ("part", "text")]
        (bad, bad_test), (good, good_test) = [[[r[0] for r in kept[2 * g + i].collect()] for i in (0, 1)] for g in (0, 1)]
        if bad and good and bad_test and good_test:
            room = min(len(dictionary(bad, size)), len(dictionary(good, size)))  # the same for both, or the larger one finds more in any text
            model = QualityModel(Dictionaries([dictionary(bad, room), dictionary(good, room)], LEVEL, CHUNK), 1.0, 0.0)
            x = np.array([model.difference(t) for t in bad_test + good_test])
            y = np.array([0] * len(bad_test) + [1] * len(good_test))
            model.slope, model.offset = fit_curve(x, y, share)
            return model
    share = min(max(share, 1e-6), 1 - 1e-6)
    return QualityModel(None, 0.0, float(np.log(share / (1 - share))))


def score(docs: DataFrame, model: QualityModel, text: str = "text", out: str = "quality") -> DataFrame:
    """``docs`` with ``out``: double from 0 to 1."""

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in slices(batches):
            yield pa.array(model.scores(texts.to_pylist()))

    return docs.withColumn(out, scored(F.col(text)))


@query("op7_quality")
def op7_quality(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = train(docs.where(~held_out), labels.where(~held_out).select("doc_id", "quality"))
    done = score(docs, model, out="score")
    return done.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
