"""Language identification by rank-order profiles of character n-grams.

A language's profile is the list of its most frequent n-grams by rank. A text is ranked the same way, whole, and
goes to the language with the least out-of-place distance: the sum over the text's n-grams of how far each is from
its rank in the profile, an n-gram outside the profile costing the profile's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm.text import cache_for, pieces

#: Ranks in a profile, and of a text that are compared with it.
RANKS = 400
#: About so many labelled documents of each language are learned from, drawn by a hash of doc_id.
TRAIN_DOCS = 3000
#: The prediction of a text without letters.
UNKNOWN = "und"

_U = np.uint64
_EDGE = 1  # stands for anything between letters; no letter has this code point
_letters: list[np.ndarray] = []


def _is_letter(points: np.ndarray) -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0][points]


def grams(text: str) -> np.ndarray:
    """Codes of all 1-, 2- and 3-grams of letters; runs of other characters, and both ends, are one edge each."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter(points)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    x = np.where(letter, points, _EDGE)[keep].astype(_U)
    if not letter.any():
        return np.zeros(0, _U)
    x = np.concatenate([[_U(_EDGE)], x, [_U(_EDGE)]]) if x[-1] != _EDGE else np.concatenate([[_U(_EDGE)], x])
    two = x[:-1] | x[1:] << _U(21)
    return np.concatenate([x[x != _EDGE], two, two[:-1] | x[2:] << _U(42)])


def ranked(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The text's most frequent n-grams and their ranks from 0; equally frequent ones share their mean rank."""
    codes, counts = np.unique(grams(text), return_counts=True)
    order = np.argsort(-counts, kind="stable")[:RANKS]
    n = counts[order]
    _, first, many = np.unique(-n, return_index=True, return_counts=True)
    return codes[order], np.repeat(first + (many - 1) / 2, many)


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "text"):
            by: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(piece["lang"].to_pylist(), piece["text"].to_pylist(), strict=True):
                by.setdefault(lang, []).append(grams(text))
            for lang, found in by.items():
                codes, counts = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(counts.astype(np.int64))], ["lang", "gram", "n"])


def learn_profiles(labelled: DataFrame, train_docs: int = TRAIN_DOCS) -> dict[str, np.ndarray]:
    """Profiles of all languages in ``labelled`` (doc_id, lang, text): n-gram codes by rank.

    About ``train_docs`` documents of each language are used, those with the smallest hashes of their doc_id; all
    of them where there are fewer. Rows with a null language or text teach nothing.
    """
    rows = labelled.where("lang is not null and text is not null").select("doc_id", "lang", "text")
    totals = rows.groupBy("lang").agg(F.count("*").alias("docs"))
    u = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / float(1 << 53)
    drawn = rows.join(F.broadcast(totals) if totals.count() <= 10_000 else totals, "lang").where(u * F.col("docs") < train_docs)
    counts = drawn.select("lang", "text").mapInArrow(_gram_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    best: dict[str, list[int]] = {}
    for r in counts.withColumn("rank", rank).where(F.col("rank") <= RANKS).select("lang", "gram").orderBy("lang", "rank").toLocalIterator():
        best.setdefault(r["lang"], []).append(r["gram"])
    return {lang: np.array(top, np.int64).astype(_U) for lang, top in best.items()}


class Classifier:
    """Profiles as one sorted table of n-grams with a column of ranks for each language."""

    def __init__(self, profiles: dict[str, np.ndarray]):
        self.langs = sorted(profiles)
        self.codes = np.unique(np.concatenate([profiles[x] for x in self.langs])) if profiles else np.zeros(0, _U)
        self.rank = np.full((len(self.langs), len(self.codes) + 1), -1.0)
        for i, lang in enumerate(self.langs):
            self.rank[i, np.searchsorted(self.codes, profiles[lang])] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and a score from 0 to 1: one less the mean out-of-place distance as a share of the worst."""
        codes, ranks = ranked(text or "")
        if not len(codes) or not self.langs:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.codes, codes)
        at[self.codes[np.minimum(at, len(self.codes) - 1)] != codes] = len(self.codes)
        there = self.rank[:, at]
        away = np.where(there < 0, RANKS, np.minimum(np.abs(there - ranks), RANKS)).sum(1)
        best = int(np.argmin(away))
        return self.langs[best], float(1 - away[best] / (RANKS * len(codes)))


def identify(docs: DataFrame, profiles: dict[str, np.ndarray]) -> DataFrame:
    """Append ``lang_pred`` and ``score`` to every row of ``docs``, from its whole ``text``.

    A null text, one without letters, and any text where nothing was learned are ``und`` with score 0. Ties go to
    the language that sorts first. Columns named like the new ones are replaced; an empty table stays empty.
    """
    docs = docs.drop("lang_pred", "score")
    model = docs.sparkSession.sparkContext.broadcast(Classifier(profiles))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache_for("language")
        for batch in batches:
            for piece in pieces(batch, "text"):
                said = [model.value.predict(x) for x in piece["text"].to_pylist()]
                new = [pa.array([x[0] for x in said], pa.string()), pa.array([x[1] for x in said], pa.float64())]
                yield pa.RecordBatch.from_arrays([*piece.columns, *new], [*piece.schema.names, "lang_pred", "score"])

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(label, schema)
