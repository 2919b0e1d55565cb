"""Reading level of each document: a linear pairwise ranker on syntax and vocabulary features, calibrated by isotonic regression.

The model is fitted on the graded samples only, at most MAX_SAMPLES of them (a documented bound on the labelled rows that
go to the driver); every document is scored inside Arrow batches.  The language is the one whose sample vocabulary covers
most of the words, whatever a language column says.  Only what is spoken counts.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.subtitles import fold, spoken_text, words
from starloom.plans.durable import spread

MAX_SAMPLES = 20_000
LEAST_WORDS = 60
RIDGE = 1e-2
STEPS = 400
FOLDS = 6  # parts of the samples of which each is scored without it for the calibration
LEVEL_PAIRS = 100_000  # pairs of samples of two levels that the ranker learns from
PAIR_SEED = 7
LEAST_KNOWN = 0.35  # part of the words that the samples of a language must have; under it the language is unknown
REACH = 2.5  # standard deviations at which a feature is cut, so that one odd feature (a text without full stops) can't decide alone
_ENDS = re.compile(r"[.!?]+")


@dataclass
class Vocabulary:
    """Per word of one language: how often the samples have it and the sum of their levels over these occurrences."""

    counts: dict[str, int]
    sums: dict[str, float]

    def grades(self) -> dict[str, float]:
        """Mean level of each word."""
        return {w: self.sums[w] / n for w, n in self.counts.items()}

    def grades_without(self, own: Counter, level: float) -> dict[str, float]:
        """Mean levels of the words of one sample of a level, its own occurrences left out, so that it isn't graded by itself."""
        return {w: (self.sums[w] - n * level) / (self.counts[w] - n) for w, n in own.items() if self.counts[w] > n}


FEATURES = ("word length", "long words", "very long words", "sentence length", "commas", "word grade", "easy words", "hard words", "distinct words")


def features(folded: str, found: list[str], grades: dict[str, float], middle: float) -> list[float]:
    """Syntax and vocabulary features of spoken text with at least one word."""
    n = len(found)
    lengths = list(map(len, found))
    sentences = max(1, len(_ENDS.findall(folded)))
    known = [grades[w] for w in found if w in grades]
    mean = sum(known) / len(known) if known else middle
    return [
        sum(lengths) / n,
        sum(x >= 7 for x in lengths) / n,
        sum(x >= 11 for x in lengths) / n,
        float(np.log(n / sentences)),
        folded.count(",") / sentences,
        mean,
        sum(g < middle - 0.75 for g in known) / max(1, len(known)),
        sum(g > middle + 0.75 for g in known) / max(1, len(known)),
        len(set(found)) / n**0.7,
    ]


def rank_pairs(level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(higher, lower): for each two levels all pairs of their samples, or LEVEL_PAIRS drawn ones where there are more.

    The draw is seeded, and it bounds the fit: its memory and time do not grow with the square of the samples.
    """
    rng = np.random.default_rng(PAIR_SEED)
    of_level = [np.flatnonzero(level == v) for v in np.unique(level)]
    higher, lower = [], []
    for k, down in enumerate(of_level):
        for up in of_level[k + 1 :]:
            if len(up) * len(down) <= LEVEL_PAIRS:
                higher.append(np.repeat(up, len(down)))
                lower.append(np.tile(down, len(up)))
            else:
                higher.append(rng.choice(up, LEVEL_PAIRS))
                lower.append(rng.choice(down, LEVEL_PAIRS))
    none = np.array([], dtype=int)
    return np.concatenate([none, *higher]), np.concatenate([none, *lower])


def rank_weights(x: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Weights of a linear scorer from pairs of different level: ridge-penalised logistic loss of score differences."""
    higher, lower = rank_pairs(level)
    gaps = x[higher] - x[lower]
    weights = np.zeros(x.shape[1])
    if not len(gaps):
        return weights
    bound = (gaps**2).sum(axis=1).mean() / 4 + RIDGE  # Lipschitz bound of the mean gradient
    for _ in range(STEPS):
        slope = -(gaps.T @ (1 / (1 + np.exp(np.clip(gaps @ weights, -50, 50))))) / len(gaps) + RIDGE * weights
        weights -= slope / bound
    return weights


def held_out_scores(x: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Score of each sample by a ranker fitted without its fold (FOLDS folds, dealt out by level)."""
    turn = np.empty(len(level), dtype=int)
    turn[np.argsort(level, kind="stable")] = np.arange(len(level)) % FOLDS
    score = np.empty(len(level))
    for k in range(FOLDS):
        score[turn == k] = x[turn == k] @ rank_weights(x[turn != k], level[turn != k])
    return score


def isotonic(score: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing least-squares fit of level on score (pool adjacent violators): knots and values for interpolation."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum, count, first score, last score
    for s, y in zip(score[order], level[order], strict=True):
        blocks.append([float(y), 1.0, float(s), float(s)])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            total, count, _, last = blocks.pop()
            blocks[-1][0] += total
            blocks[-1][1] += count
            blocks[-1][3] = last
    return np.array([(b[2] + b[3]) / 2 for b in blocks]), np.array([b[0] / b[1] for b in blocks])


@dataclass
class LevelModel:
    """One language: word grades, feature scaling, ranker weights and the isotonic calibration."""

    grades: dict[str, float]
    middle: float
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def score(self, folded: str, found: list[str]) -> float:
        x = (np.array(features(folded, found, self.grades, self.middle)) - self.center) / self.scale
        return float(np.clip(x, -REACH, REACH) @ self.weights)

    def level(self, score: float) -> int:
        return int(np.floor(np.interp(score, self.knots, self.values) + 0.5))


def fit(samples: list[tuple[str, int, str]]) -> dict[str, LevelModel]:
    """A model per language from (language, level, text)."""
    by_language = defaultdict(list)
    for language, level, text in samples:
        folded = fold(text or "")
        found = words(folded)
        if found:
            by_language[language].append((level, folded, found))
    models = {}
    for language, rows in by_language.items():
        counts: Counter = Counter()
        sums: dict[str, float] = defaultdict(float)
        for level, _, found in rows:
            for word, n in Counter(found).items():
                counts[word] += n
                sums[word] += n * level
        vocabulary, middle = Vocabulary(counts, sums), float(np.mean(sorted({r[0] for r in rows})))
        x = np.array([features(f, w, vocabulary.grades_without(Counter(w), v), middle) for v, f, w in rows])
        y = np.array([r[0] for r in rows], dtype=float)
        center, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = np.clip((x - center) / scale, -REACH, REACH)
        weights = rank_weights(z, y)
        knots, values = isotonic(held_out_scores(z, y) if len(y) >= 2 * FOLDS else z @ weights, y)
        models[language] = LevelModel(vocabulary.grades(), middle, center, scale, weights, knots, values)
    return models


def language_words(models: dict[str, LevelModel]) -> dict[str, dict[str, float]]:
    """Words of each language with the weight 1 / number of languages that have them."""
    shared = Counter(w for m in models.values() for w in m.grades)
    return {language: {w: 1 / shared[w] ** 2 for w in m.grades} for language, m in models.items()}


def spoken_language(found: list[str], known: dict[str, dict[str, float]]) -> str | None:
    """Language whose vocabulary covers most of the words; ties go to the first name; None if it has too few of them."""
    counts = Counter(found)
    best = max(sorted(known), key=lambda k: sum(n * known[k].get(w, 0.0) for w, n in counts.items()))
    return best if sum(n for w, n in counts.items() if w in known[best]) >= LEAST_KNOWN * len(found) else None


def reading_levels(
    documents: DataFrame, samples: DataFrame, doc: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS
) -> DataFrame:
    """(doc, language, n_words, score, level) of each document with at least least_words spoken words.

    Null, empty and advert-only texts have no spoken words and no row.  A text in a language without samples has a row
    with a null language, score and level.  samples: lang, level, text, at most MAX_SAMPLES
    rows; without samples there is no level and no row.  Repeated documents get the same level each.
    """
    rows = samples.select("lang", "level", "text").limit(MAX_SAMPLES + 1).collect()
    if len(rows) > MAX_SAMPLES:
        raise ValueError(f"more than {MAX_SAMPLES} graded samples; pass a sample of them")
    models = fit([tuple(r) for r in rows])
    shared = documents.sparkSession.sparkContext.broadcast((models, language_words(models)))
    kind = documents.schema[doc].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, known = shared.value
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                folded = spoken_text(body)
                found = words(folded)
                if len(found) < max(1, least_words) or not fitted:
                    continue
                language = spoken_language(found, known)
                score = fitted[language].score(folded, found) if language else None
                level = fitted[language].level(score) if language else None
                for values, value in zip(out, (key, language, len(found), score, level), strict=True):
                    values.append(value)
            kinds = (batch.column(0).type, pa.string(), pa.int32(), pa.float64(), pa.int32())
            names = ["doc", "language", "n_words", "score", "level"]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names)

    source = documents.select(F.col(doc).alias("doc"), F.col(text).alias("text")).filter("text is not null")
    scored = spread(source).mapInArrow(run, f"doc {kind}, language string, n_words int, score double, level int")
    return scored.withColumnRenamed("doc", doc)
