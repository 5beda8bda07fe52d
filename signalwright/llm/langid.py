"""Language ID by hierarchical discrimination: the family first, then one-versus-one linear support vector machines within it.

Features are hashed byte trigrams of the whole lower-cased text, with everything but letters as one separator, under square root and unit
length. Families are told apart, and the languages of a family, by a linear support vector machine for each pair (squared hinge loss,
full-batch gradient steps with momentum, at fixed steps and from zero, so that the fit is repeatable). The one with the most wins is
taken; of ties, the one with the greatest sum of margins, then the first by name.

The fit uses at most `per_language` labelled rows of each language (`PER_LANGUAGE`, drawn by a hash of doc_id from all labelled rows); the
prediction covers every row and every byte of its text.

Defined results: a null text, or one without a letter, is `und` with score 0; with one learned language, that is predicted with score 1;
with none, every row is `und`; a very long text is read whole, in blocks; rows that repeat a doc_id, or each other, are each predicted,
equal texts alike; an empty table gives no rows; all other columns come back as they are, and the added one takes a free name; lang,
source and doc_id never enter a prediction.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalwright.llm._common import crc_mod, fresh

DIMENSIONS = 1 << 13
#: The bound of the sample that the machines are fitted on: rows of a language.
PER_LANGUAGE = 400
UNKNOWN = "und"
#: Languages by family; a language that isn't listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "af", "sv", "da", "no", "nb", "nn", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "bg", "sr", "hr", "bs", "sl", "mk", "cs", "sk", "pl"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indo-aryan": ("hi", "ur", "bn", "mr", "ne", "pa"),
}
_PLAIN_LETTER = re.compile("[A-Za-z]")
_CLASS = np.array([b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], dtype=np.uint32)


def has_letter(text: str) -> bool:
    return _PLAIN_LETTER.search(text) is not None or any(map(str.isalpha, text))


def features(text: str, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Unit-length square roots of the trigram counts."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), dtype=np.uint8)
    counts = np.zeros(dimensions, dtype=np.float64)
    for lo in range(0, len(raw) - 2, 1 << 20):
        a = _CLASS[raw[lo : lo + (1 << 20) + 2]]
        h = (a[:-2] * np.uint32(0x9E3779B1)) ^ (a[1:-1] * np.uint32(0x85EBCA77)) ^ (a[2:] * np.uint32(0xC2B2AE3D))
        counts += np.bincount((h >> np.uint32(15)) & np.uint32(dimensions - 1), minlength=dimensions)
    x = np.sqrt(counts)
    return (x / np.sqrt(x @ x)).astype(np.float32)


def fit_machine(x: np.ndarray, y: np.ndarray, steps: int = 200, penalty: float = 1e-3) -> np.ndarray:
    """Weights and, last, the bias of a linear machine with squared hinge loss; both classes weigh the same. y: 1, -1, or 0 for rows of
    other classes, which have no part in it (the samples stay in one array)."""
    w, v = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    for _ in range(steps):
        lack = np.maximum(0.0, 1.0 - y * (x @ w[:-1].astype(np.float32) + w[-1])) * y * share
        grad = np.append(-2 * (lack.astype(np.float32) @ x) + penalty * w[:-1], -2 * lack.sum())
        v = 0.9 * v - 0.5 * grad
        w = w + v
    return w


@dataclass(frozen=True)
class Duel:
    """One-versus-one machines of some classes; weights: a row for each pair (i, j), positive for i."""

    names: tuple[str, ...]
    pairs: tuple[tuple[int, int], ...]
    weights: np.ndarray

    @staticmethod
    def fit(x: np.ndarray, label: np.ndarray, names: tuple[str, ...]) -> Duel:
        pairs = tuple(combinations(range(len(names)), 2))
        rows = []
        for i, j in pairs:
            rows.append(fit_machine(x, (label == names[i]) * 1.0 - (label == names[j])))
        return Duel(names, pairs, np.array(rows).reshape(len(pairs), x.shape[1] + 1 if len(x) else 1))

    def winner(self, x: np.ndarray) -> tuple[str, float]:
        """The winner and how sure: the mean over its duels of the logistic function of four times the margin."""
        if len(self.names) == 1:
            return self.names[0], 1.0
        margins = self.weights[:, :-1] @ x + self.weights[:, -1]
        wins, total, sure = ([0.0] * len(self.names) for _ in range(3))
        for (i, j), m in zip(self.pairs, margins.tolist(), strict=True):
            p = 1 / (1 + np.exp(-4 * m))
            wins[i if m > 0 else j] += 1
            total[i] += m
            total[j] -= m
            sure[i] += p
            sure[j] += 1 - p
        best = min(range(len(self.names)), key=lambda k: (-wins[k], -total[k], self.names[k]))
        return self.names[best], float(sure[best] / (len(self.names) - 1))


@dataclass(frozen=True)
class Model:
    families: Duel | None
    languages: dict[str, Duel]

    def predict(self, text: str | None) -> tuple[str, float]:
        if self.families is None or text is None or not has_letter(text):
            return UNKNOWN, 0.0
        x = features(text)
        family, sure = self.families.winner(x)
        lang, within = self.languages[family].winner(x)
        return lang, min(1.0, sure * within)


def sample(docs: DataFrame, held_out: Column, per_language: int = PER_LANGUAGE) -> tuple[np.ndarray, np.ndarray]:
    """Languages and features (a row each) of at most per_language rows of each learned language, in the order of their draw."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out)
    order = F.xxhash64(F.lit("fit"), F.col("doc_id"))
    counts = labelled.groupBy("lang").count().collect()  # one row for each language
    chance = F.lit(0.0)
    for r in counts:
        chance = F.when(F.col("lang") == r["lang"], F.lit(1.5 * per_language / r["count"])).otherwise(chance)
    # a hash below the bound first, so that only about 1.5 times the sample is ranked
    drawn = labelled.where(order.bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52)) < chance).select("lang", "text", order.alias("o"))
    ranked = drawn.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("o", F.xxhash64("text")))).where(F.col("n") <= per_language)
    rows = [r for r in ranked.select("lang", "n", _features_udf()(F.col("text")).alias("x")).collect() if r["x"] is not None]
    rows.sort(key=lambda r: (r["lang"], r["n"]))
    x = np.zeros((len(rows), DIMENSIONS), dtype=np.float32)
    for own, r in zip(x, rows, strict=True):
        n = len(r["x"]) // 6
        own[np.frombuffer(r["x"], "<u2", n)] = np.frombuffer(r["x"], "<f4", n, 2 * n)
    return np.array([r["lang"] for r in rows], dtype=object), x


def _features_udf():
    """The features that aren't zero: their numbers, 16 bits each, then their values, 32 bits each."""

    def sparse(x: np.ndarray) -> bytes:
        at = np.flatnonzero(x)
        return at.astype("<u2").tobytes() + x[at].astype("<f4").tobytes()

    @F.arrow_udf("binary")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([sparse(features(t)) if t and has_letter(t) else None for t in texts.to_pylist()], pa.binary())

    return of


def fit(docs: DataFrame, held_out: Column, families: Mapping[str, tuple[str, ...]] = FAMILIES, per_language: int = PER_LANGUAGE) -> Model:
    lang, x = sample(docs, held_out, per_language)
    if not len(lang):
        return Model(None, {})
    family_of = {own: f for f, langs in families.items() for own in langs}
    family = np.array([family_of.get(own, own) for own in lang], dtype=object)
    within = {f: Duel.fit(x, lang, tuple(sorted(set(lang[family == f])))) for f in sorted(set(family))}
    return Model(Duel.fit(x, family, tuple(within)), within)


def predict(docs: DataFrame, model: Model, name: str) -> DataFrame:
    """docs with a struct column of that name: lang_pred, score."""
    spread = docs.sparkSession.sparkContext.broadcast(model)  # a row of DIMENSIONS numbers for each pair of languages in a family

    @F.arrow_udf("lang_pred string, score double")
    def run(texts: pa.Array) -> pa.Array:
        own = spread.value
        found = [own.predict(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["lang_pred", "score"])

    return docs.withColumn(name, run.asNondeterministic()(F.col("text")))


def identify(docs: DataFrame, held_out: Column | None = None, per_language: int = PER_LANGUAGE) -> DataFrame:
    """docs plus a struct `prediction` (or a name that is free): lang_pred and score. held_out rows aren't learned from."""
    held_out = crc_mod(F.col("doc_id"), 4) == 2 if held_out is None else held_out
    return predict(docs, fit(docs, held_out, per_language=per_language), fresh(docs, "prediction"))
