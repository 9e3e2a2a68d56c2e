"""Reading level of each document: quantiles of the grades at which its words are acquired.

1. A word's grade comes from its use in graded texts: per level its share of all words, these shares scaled to sum
   to one, and of that distribution the level by which the first ``ACQUIRED`` of its use has been met.
2. A document is described by quantiles of the grades of its known words, whatever its language.
3. Least squares on the graded documents turn the quantiles into a score, and four cuts turn the score into a level. For
   this fit the graded documents are described by grades from the other graded documents only (``FOLDS`` parts, each
   left out in turn), as all documents without a grading are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segscan.llm.words import letter_words, spread
from segscan.operators.joins import lookup
from segscan.sources.tables import checkpointed

LEVELS = (1, 2, 3, 4, 5)
#: Part of a word's use by which it counts as acquired, and graded documents that a known word must be in.
ACQUIRED, LEAST_DOCS = 0.25, 3
#: Quantiles of word grades that describe a document.
QUANTILES = (0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.97)
#: Graded documents that the calibration is fitted on at most (a sample by hash beyond it).
MOST_GRADED = 20_000
#: Parts of the graded documents for the calibration.
FOLDS = 5
#: Known words up to which their table is broadcast; a larger one is joined by shuffle.
BROADCAST_WORDS = 300_000


@dataclass
class Calibration:
    """Score = weights * (1, quantiles); a level is one more than the number of cuts below the score."""

    weights: list[float]
    cuts: list[float]

    def level(self, quantiles: Column) -> Column:
        score = F.lit(self.weights[0])
        for i, w in enumerate(self.weights[1:]):
            score = score + F.lit(w) * quantiles[i]
        return sum((F.when(score > c, 1).otherwise(0) for c in self.cuts), F.lit(1)).cast("int")


def grades_of(labels: DataFrame) -> DataFrame:
    """``doc_id, level`` (the mean of a document's gradings), of at most ``MOST_GRADED`` documents."""
    return labels.filter(F.col("doc_id").isNotNull() & F.col("level_no").between(1, 5)).groupBy("doc_id").agg(F.avg("level_no").alias("level")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_GRADED)


def graded_words(docs: DataFrame, graded: DataFrame) -> DataFrame:
    """``doc_id, fold, level, word, n``: how often each graded document has each word; ``level`` is a whole number here."""
    texts = docs.join(F.broadcast(graded), "doc_id")  # at most MOST_GRADED rows
    each = texts.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold"), F.least(F.lit(5), F.round("level")).cast("int").alias("level"), F.explode(letter_words(F.col("text"))).alias("word"))
    return each.groupBy("doc_id", "fold", "level", "word").agg(F.count("*").alias("n"))


def _acquired(per: DataFrame, totals: DataFrame, on: list[str]) -> DataFrame:
    """``on`` and ``grade`` of the words in at least ``LEAST_DOCS`` documents. ``per``: n_docs, n_1 to n_5; ``totals``: total_1 to total_5."""
    known = per.filter(F.col("n_docs") >= LEAST_DOCS)
    rates = (known.join(F.broadcast(totals), "fold") if "fold" in on else known.crossJoin(F.broadcast(totals))).withColumns({f"r_{k}": F.col(f"n_{k}") / F.greatest(F.col(f"total_{k}"), F.lit(1)) for k in LEVELS})  # totals: one row, or one per fold
    whole = sum((F.col(f"r_{k}") for k in LEVELS), F.lit(0.0))
    grade, upto = None, F.lit(0.0)
    for k in LEVELS:
        share = F.col(f"r_{k}") / whole
        met = upto + share >= ACQUIRED - 1e-12
        here = F.lit(float(k - 1)) + (F.lit(ACQUIRED) - upto) / share
        grade = F.when(met, here) if grade is None else grade.when(met, here)
        upto = upto + share
    return rates.select(*on, F.round(grade, 2).alias("grade"))


def word_grades(used: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``word, grade`` from all graded documents, and ``word, fold, grade`` from those of all folds but one.

    ``used``: see ``graded_words``. Everything is counted per word and fold once; a fold is left out by taking its counts away.
    """
    counts = [F.count("*").alias("n_docs"), *[F.coalesce(F.sum(F.when(F.col("level") == k, F.col("n"))), F.lit(0)).alias(f"n_{k}") for k in LEVELS]]
    names = ["n_docs", *[f"n_{k}" for k in LEVELS]]
    per_fold = used.groupBy("word", "fold").agg(*counts)
    packed = per_fold.groupBy("word").agg(*[F.sum(c).alias(c) for c in names], F.collect_list(F.struct("fold", *names)).alias("_f"))  # FOLDS entries at most
    in_fold = used.groupBy("fold").agg(*[F.coalesce(F.sum(F.when(F.col("level") == k, F.col("n"))), F.lit(0)).alias(f"total_{k}") for k in LEVELS])
    totals = in_fold.agg(*[F.coalesce(F.sum(f"total_{k}"), F.lit(0)).alias(f"total_{k}") for k in LEVELS])
    others = in_fold.select("fold", *[F.col(f"total_{k}").alias(f"_{k}") for k in LEVELS]).crossJoin(F.broadcast(totals)).select("fold", *[(F.col(f"total_{k}") - F.col(f"_{k}")).alias(f"total_{k}") for k in LEVELS])
    # Only a fold that has the word can ask for its grade.
    without = packed.select("word", *names, F.explode("_f").alias("_x")).select("word", F.col("_x.fold").alias("fold"), *[(F.col(c) - F.col(f"_x.{c}")).alias(c) for c in names])
    return _acquired(packed, totals, ["word"]), _acquired(without, others, ["word", "fold"])


def described(each: DataFrame, known: DataFrame, on: list[str], n: str | None = None) -> DataFrame:
    """``doc_id, n_known, quantiles`` (null without a known word) of the documents whose words are the rows of ``each``; no frequent word is one task."""
    looked = lookup(each, known, on, F.col("doc_id"), most=BROADCAST_WORDS)
    n_known, weight = (F.count("grade"), ()) if n is None else (F.coalesce(F.sum(F.when(F.col("grade").isNotNull(), F.col(n))), F.lit(0)), (F.col(n),))
    return looked.groupBy("doc_id").agg(n_known.alias("n_known"), F.percentile("grade", F.array(*[F.lit(q) for q in QUANTILES]), *weight).alias("quantiles"))


def calibrate(graded_docs: DataFrame, graded: DataFrame) -> Calibration:
    """Fitted on the graded documents that have known words (at most ``MOST_GRADED``); without any, level 1 for all."""
    rows = graded_docs.filter("n_known > 0").join(F.broadcast(graded), "doc_id").orderBy("doc_id").select("quantiles", "level").collect()
    if not rows:
        return Calibration([0.0] * (len(QUANTILES) + 1), [])
    x = np.column_stack((np.ones(len(rows)), np.array([r[0] for r in rows])))
    y = np.array([r[1] for r in rows])
    ridge = 1e-2 * np.eye(x.shape[1]) * len(rows) ** 0.5
    ridge[0, 0] = 0
    w = np.linalg.solve(x.T @ x + ridge + 1e-9 * np.eye(x.shape[1]), x.T @ y)
    score = x @ w
    order = np.argsort(score, kind="stable")
    s = score[order]
    cuts: list[float] = []
    for k in LEVELS[:-1]:
        above = (y[order] > k + 0.25).astype(int)
        wrong = np.concatenate(([0], np.cumsum(above))) + np.concatenate((np.cumsum((1 - above)[::-1])[::-1], [0]))
        best = np.flatnonzero(wrong == wrong.min())
        i = int(best[len(best) // 2])
        cut = -np.inf if i == 0 else np.inf if i == len(s) else (s[i - 1] + s[i]) / 2
        cuts.append(float(max([cut, *cuts[-1:]])))
    return Calibration(w.tolist(), [c if np.isfinite(c) else float(np.sign(c) * 1e9) for c in cuts])


def reading_level(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, level, n_known``: one row per document, from 1 to 5; null for null and empty texts and where no word is known.

    ``docs``: doc_id, text. ``labels``: doc_id, level_no; gradings of unknown documents and outside 1 to 5 are left
    out, several of one document are averaged. Rows with the same doc_id are one document. Other columns don't matter.
    The documents are read twice, once for the graded ones and once to be described; words are looked up where the text is
    read and counted per grade before the shuffle.
    """
    docs = spread(docs.select("doc_id", "text"), "doc_id")
    graded = checkpointed(grades_of(labels))
    used = checkpointed(graded_words(docs, graded))
    grades, without = map(checkpointed, word_grades(used))
    model = calibrate(described(used, without, ["word", "fold"], "n"), graded)
    each = docs.select("doc_id", F.explode_outer(letter_words(F.col("text"))).alias("word"))
    return described(each, grades, ["word"]).select("doc_id", F.when(F.col("n_known") > 0, model.level(F.col("quantiles"))).alias("level"), "n_known")
