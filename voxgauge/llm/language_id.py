"""Language identification with a string kernel: n-gram presence, Nystroem landmarks, one-versus-rest ridge regression.

Kernel. Two texts are as alike as the sets of their 1-, 2- and 3-grams: for each length the common n-grams over the
geometric mean of both counts, averaged over the lengths (blended spectrum, presence only). N-grams are over small letters
with every stretch of other characters as one blank, hashed into a fixed number of places per length.

Landmarks. A text is mapped to its kernel values with the landmarks, whitened by the landmarks' own kernel matrix; ridge
regression of +1/-1 per language on these features gives the weights.

Scoring. Kernel values are products of presence matrices, so features, landmarks and weights multiply out to one matrix of
places by languages per length. Texts are scored in batches by one product with it; no landmark is visited per text.

Fitting takes at most ``per_language`` different labelled texts of each language as bits of ``sum(PLACES)`` places each;
their number of languages times that many rows reach the driver. They are the ones with the smallest hashes of all different
texts of the language, however often each occurs: copies are dropped first, and every task passes on no more hashes of a
language than are wanted. Scoring covers all texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxgauge.llm.shared import id_remainder, small_batches

PLACES = (1 << 9, 1 << 12, 1 << 15)  # places for 1-, 2- and 3-grams
_STARTS = np.concatenate([[0], np.cumsum(PLACES)])
_FACTORS = np.array([2654435761, 2246822519, 3266489917], np.uint32)  # odd constants of multiplicative hashing
PER_LANGUAGE = 300
#: Classes of hashes per language in the steps to the smallest ones; after the first, a task reads eight times the sample.
HASH_CLASSES = (64, 8, 1)
LANDMARKS = 240
RIDGE = 1e-4
SHARPNESS = 4.0  # turns margins into a score
UNKNOWN = "und"
BLOCK = 1 << 20
BATCH = 64  # texts per matrix product

_LETTER = re.compile(r"[^\W\d_]")


def mark(text: str, row: np.ndarray) -> None:
    """Set the places of all n-grams of a text; blocks overlap by two characters so that no n-gram is lost."""
    at = 0
    while True:
        codes = np.frombuffer(text[max(0, at - 2):at + BLOCK].lower().encode("utf-32-le"), "<u4")
        other = (codes < 97) | ((codes > 122) & (codes < 192)) | (codes == 215) | (codes == 247)
        if other.any():
            codes = np.where(other, 32, codes).astype(np.uint32)
            codes = codes[~(other & np.concatenate([[False], other[:-1]]))]
        mixed = np.zeros(len(codes), np.uint32)
        for n, places in enumerate(PLACES):
            if len(codes) <= n:
                break
            mixed = (mixed[:len(codes) - n] + codes[n:]) * _FACTORS[n]
            row[_STARTS[n] + (mixed >> np.uint32(33 - places.bit_length()))] = 1
        at += BLOCK
        if at >= len(text):
            return


def has_letter(text: str | None) -> bool:
    return bool(text and _LETTER.search(text))


def _norms(marks: np.ndarray) -> list[np.ndarray]:
    """Per length the inverse root of how many n-grams each row has."""
    return [1 / np.sqrt(np.maximum(marks[:, a:b].sum(axis=1), 1)) for a, b in zip(_STARTS, _STARTS[1:])]


def kernel(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Blended-spectrum presence kernel of two matrices of marks."""
    out = np.zeros((len(left), len(right)))
    for (a, b), x, y in zip(zip(_STARTS, _STARTS[1:]), _norms(left), _norms(right)):
        out += (left[:, a:b] @ right[:, a:b].T) * x[:, None] * y[None, :]
    return out / len(PLACES)


@dataclass
class LanguageModel:
    """Languages, a matrix of places by languages, and the bias of each language."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray

    def margins(self, marks: np.ndarray) -> np.ndarray:
        out = np.zeros((len(marks), len(self.languages)))
        for (a, b), norm in zip(zip(_STARTS, _STARTS[1:]), _norms(marks)):
            out += (marks[:, a:b] @ self.weights[a:b]) * norm[:, None]
        return out + self.bias

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text; ``und`` and 0 without a letter or without a learned language."""
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        rows = [i for i, t in enumerate(texts) if self.languages and has_letter(t)]
        for start in range(0, len(rows), BATCH):
            chosen = rows[start:start + BATCH]
            marks = np.zeros((len(chosen), _STARTS[-1]), np.float32)
            for row, i in zip(marks, chosen):
                mark(texts[i], row)
            margins = SHARPNESS * self.margins(marks)
            odds = np.exp(margins - margins.max(axis=1, keepdims=True))
            best = odds.argmax(axis=1)
            share = odds.max(axis=1) / odds.sum(axis=1)
            for i, k, s in zip(chosen, best.tolist(), share.tolist()):
                names[i], scores[i] = self.languages[k], s
        return names, scores


def fit(marks: np.ndarray, labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> LanguageModel:
    """Kernel ridge regression on Nystroem features; rows come grouped or not, landmarks are taken evenly over languages."""
    languages = sorted(set(labels))
    if not languages:
        return LanguageModel([], np.zeros((_STARTS[-1], 0), np.float32), np.zeros(0))
    targets = np.array([[1.0 if x == language else -1.0 for language in languages] for x in labels])
    share = max(1, landmarks // len(languages))
    chosen = np.concatenate([np.flatnonzero(targets[:, k] > 0)[:share] for k in range(len(languages))])
    centres = marks[chosen].astype(np.float32)
    values, vectors = np.linalg.eigh(kernel(centres, centres))
    good = values > 1e-8 * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])
    features = np.concatenate([kernel(marks[i:i + BATCH].astype(np.float32), centres) for i in range(0, len(marks), BATCH)])
    features = features @ whiten
    mean, bias = features.mean(axis=0), targets.mean(axis=0)
    centred = features - mean
    solved = np.linalg.solve(centred.T @ centred + ridge * len(marks) * np.eye(good.sum()), centred.T @ (targets - bias))
    on_landmarks = whiten @ solved / len(PLACES)
    weights = np.zeros((_STARTS[-1], len(languages)), np.float32)
    for (a, b), norm in zip(zip(_STARTS, _STARTS[1:]), _norms(centres)):
        weights[a:b] = centres[:, a:b].T @ (on_landmarks * norm[:, None])
    return LanguageModel(languages, weights, bias - mean @ solved)


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", modulus: int = 4,
          held_out: int = 2, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS) -> LanguageModel:
    """Learn from labelled texts with a letter whose id has a crc32 remainder other than ``held_out``.

    A null id counts as the empty text in the remainder, so such rows are learned from unless that remainder is held out.
    Without a text to learn from, the model knows no language and ``identify`` answers ``und``.
    """
    small_batches(docs.sparkSession)
    known = docs.filter((id_remainder(doc_id, modulus) != held_out) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    known = known.select(F.col(lang).cast("string").alias("lang"), F.xxhash64(text).alias("hash"), F.col(text).alias("text"))
    known = known.filter(F.col("text").rlike(r"\p{L}"))
    # the smallest hashes of a language are among the smallest of its hash classes: no task sees a whole language
    chosen = known.select("lang", "hash").distinct()
    for classes in HASH_CLASSES:
        by_hash = W.partitionBy("lang", F.pmod("hash", F.lit(classes))).orderBy("hash")
        chosen = chosen.withColumn("n", F.row_number().over(by_hash)).filter(F.col("n") <= per_language).drop("n")

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column(2):
                row = np.zeros(_STARTS[-1], np.uint8)
                mark(value.as_py(), row)
                out.append(np.packbits(row).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.binary())], ["lang", "hash", "bits"])

    # the chosen hashes have at most ``per_language`` rows per language; copies of a text count once
    sample = known.join(F.broadcast(chosen), ["lang", "hash"], "left_semi").mapInArrow(
        bits, "lang string, hash long, bits binary")
    rows = sample.groupBy("lang", "hash").agg(F.first("bits").alias("bits")).orderBy("lang", "hash").collect()
    marks = np.unpackbits(np.frombuffer(b"".join(r["bits"] for r in rows), np.uint8)).reshape(-1, _STARTS[-1])
    return fit(marks, [r["lang"] for r in rows], landmarks)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", pred: str = "lang_pred",
             score: str = "score") -> DataFrame:
    """Add ``pred`` (a learned language, or ``und``) and ``score`` (0 to 1); every row and column stays.

    Null texts and texts without a letter are ``und`` with score 0. Only the text decides, so repeated texts agree. Columns
    of the two names are replaced.
    """
    small_batches(docs.sparkSession)
    shared, kept = docs.sparkSession.sparkContext.broadcast(model), docs.drop(pred, score)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = shared.value.predict(batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                [*batch.schema.names, pred, score])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{schema}, `{pred}` string, `{score}` double")
