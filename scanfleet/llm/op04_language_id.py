"""Language identification by compression.

Each language has a zstandard raw-content dictionary made of excerpts of its texts. A text is compressed with each of them,
and the language whose dictionary makes it smallest is predicted. The relative margin to the second decides how sure that is. Where it is
narrow, the text is compressed once more at the strongest level; where it stays narrow, the text is rejected.

Dictionaries come from a bounded sample: at most ``per_language`` distinct texts of each of the ``max_languages`` values of lang that have the most rows (ties by
name; others are not learned), excerpts of ``excerpt_chars``, shortened to one length where a language's don't fit ``size`` bytes. Everything is lower-cased. Null texts and texts without a letter are ``und`` with score 0 and rejected, as is everything where no
language was learned; with one language learned, every other text is predicted as it with score 1. Ties go to the language that comes
first by name. Repeated rows get equal predictions; texts of any length are read whole. A column that already has the output's
name is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import slices
from .compression import Dictionaries, dictionary, excerpt, sample
from .registry import query, table

UND = "und"
LEVEL, STRONGEST, CHUNK = 6, 19, 4096
NARROW = 0.002
#: Margin at which the score is 1 - 1/e.
SURE = 0.03


@dataclass
class LanguageModel:
    languages: list[str]
    dictionaries: Dictionaries
    narrow: float = NARROW

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected)."""
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UND, 0.0, True
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        data = text.lower().encode()
        best, margin = self._best(data, None)
        if margin <= self.narrow:
            best, margin = self._best(data, STRONGEST)
        return best, 1 - math.exp(-margin / SURE), margin <= self.narrow

    def _best(self, data: bytes, level: int | None) -> tuple[str, float]:
        ranked = sorted(zip(self.dictionaries.sizes(data, level), self.languages))
        return ranked[0][1], (ranked[1][0] - ranked[0][0]) / ranked[1][0]


def train(labelled: DataFrame, per_language: int = 400, excerpt_chars: int = 1500, size: int = 200_000, narrow: float = NARROW, max_languages: int = 200) -> LanguageModel:
    """A model from rows of text and lang; rows where either is null or the text is empty teach nothing."""
    rows = labelled.where(F.col("lang").isNotNull() & (F.length("text") > 0)).select("lang", "text")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()}
    few = sample(rows, "lang", counts, per_language, F.col("text")).select("lang", "hash", F.lower(excerpt(F.col("text"), excerpt_chars)).alias("text"))
    texts: dict[str, list[str]] = {}
    for r in sorted(few.collect(), key=lambda r: r["hash"]):
        texts.setdefault(r["lang"], []).append(r["text"])
    languages = sorted(texts)
    return LanguageModel(languages, Dictionaries([dictionary(texts[x], size) for x in languages], LEVEL, CHUNK), narrow)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with ``out``: struct of lang, score and rejected."""

    @F.arrow_udf("struct<lang:string,score:double,rejected:boolean>")
    def predicted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in slices(batches):
            rows = [model.predict(t.as_py()) for t in texts]
            yield pa.StructArray.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.bool_())], names=["lang", "score", "rejected"]
            )

    return docs.withColumn(out, predicted(F.col(text)))


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))



@query("op4_language_id")
def op4_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold(F.col("doc_id"), 3) == 1
    model = train(docs.where(~held_out))
    done = identify(docs.select("doc_id", "text"), model)
    return done.select("doc_id", held_out.alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"), F.col("language.rejected").alias("rejected"))
