"""Document quality from a CRF over lines: each line is good or bad by its own and its neighbours' features."""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestore.llm.crf import Crf, fit, logistic, sigmoid
from lodestore.llm.labelled import held_out, sample
from lodestore.llm.text import keyed_texts, slices

#: Documents labelled 0 and 1 that the model is fitted on at most.
TRAIN_EACH = (1500, 1500)
THRESHOLD = 0.7
_UPPER, _DIGIT, _MARK = bytes(range(65, 91)), bytes(range(48, 58)), b"#*$%&|<>"
#: What is measured of a line, and the upper edges of the classes it falls into.
MEASURES = {
    "words": (1, 2, 5, 10, 20, 40),
    "symbols": (0, 0.01, 0.05, 0.1),
    "capitals": (0, 0.02, 0.05, 0.1, 0.3, 0.6),
    "bars": (0, 0.1, 0.3),
    "distinct words": (0.3, 0.5, 0.7, 0.85, 0.95),
    "equal neighbour words": (0, 0.02, 0.1, 0.3),
    "digits": (0, 0.02, 0.1, 0.3),
    "bytes a word": (2.5, 4, 5.5, 7, 9, 14),
    "exclamations": (0, 0.1, 0.5),
    "copies a line above": (0,),
    "ends a sentence": (0,),
    "share of the text": (0.02, 0.1, 0.3, 0.9),
}
_WIDTH = 8
_FIELDS = len(MEASURES)


def measure(text: bytes) -> tuple[list[tuple[float, ...]], list[int]]:
    """The measures of each line with a word, and its length in bytes."""
    rows, sizes, seen = [], [], set()
    total = max(len(text), 1)
    for line in text.split(b"\n"):
        words = line.split()
        if not words:
            continue
        n, ink = len(words), b"".join(words)
        size = len(ink)
        rows.append(
            (
                n,
                1 - len(ink.translate(None, _MARK)) / size,
                1 - len(ink.translate(None, _UPPER)) / size,
                ink.count(b"|") / n,
                len(set(words)) / n,
                sum(map(eq, words, words[1:])) / n,
                1 - len(ink.translate(None, _DIGIT)) / size,
                size / n,
                ink.count(b"!") / n,
                line in seen,
                ink[-1:] in b".?!",
                len(line) / total,
            )
        )
        seen.add(line)
        sizes.append(len(line))
    return rows, sizes


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature indices of each line, lengths, where each text's lines begin): own classes, then those of the line before and after."""
    rows, sizes, at = [], [], [0]
    for text in texts:
        r, s = measure(text)
        rows += r
        sizes += s
        at.append(len(rows))
    raw = np.array(rows, float).reshape(len(rows), _FIELDS)
    own = np.stack([np.searchsorted(np.array(edges, float), raw[:, i]) for i, edges in enumerate(MEASURES.values())], axis=1) if rows else np.empty((0, _FIELDS), np.int64)
    own = own + np.arange(_FIELDS) * _WIDTH
    at = np.array(at, np.int64)
    none = _WIDTH - 1 + np.arange(_FIELDS) * _WIDTH
    before, after = np.vstack([none[None], own[:-1]])[: len(own)], np.vstack([own[1:], none[None]])[-len(own) :] if len(own) else own
    starts = at[:-1][np.diff(at) > 0]
    before[starts] = none
    after[at[1:][np.diff(at) > 0] - 1] = none
    block = _FIELDS * _WIDTH
    return np.hstack([own, before + block, after + 2 * block, np.full((len(own), 1), 3 * block)]), np.array(sizes, float), at


@dataclass
class QualityModel:
    crf: Crf
    slope: float
    intercept: float

    def lines(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(good) of each line, lengths, and where texts begin."""
        x, sizes, at = features(texts)
        return self.crf.marginals(self.crf.weights[x].sum(axis=1), at), sizes, at

    def evidence(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of the length-weighted share of good lines, and whether there is a line at all."""
        p, sizes, at = self.lines(texts)
        some = np.diff(at) > 0
        share = np.zeros(len(texts))
        if some.any():
            share[some] = np.add.reduceat(p * sizes, at[:-1][some]) / np.add.reduceat(sizes, at[:-1][some])
        share = np.clip(share, 1e-4, 1 - 1e-4)
        return np.log(share) - np.log1p(-share), some

    def score(self, texts: list[bytes]) -> np.ndarray:
        x, some = self.evidence(texts)
        return np.where(some, sigmoid(self.slope * x + self.intercept), 0.0)


def train(docs: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2, each: tuple[int, int] = TRAIN_EACH, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """Fit on a bounded sample: lines take their document's label. Without both labels every text scores 0.5."""
    texts, y = sample(docs, labels, "quality", modulus, remainder, each, id_col, text_col)
    y = np.array(y, np.int64)
    model = QualityModel(Crf(np.zeros(3 * _FIELDS * _WIDTH + 1), np.zeros((2, 2))), 0.0, 0.0)
    if len(set(y.tolist())) == 2:
        x, _, at = features(texts)
        model.crf = fit(x, np.repeat(y, np.diff(at)), at[np.concatenate([[True], np.diff(at) > 0])], len(model.crf.weights))
        evidence, some = model.evidence(texts)
        model.slope, model.intercept = logistic(evidence[some], y[some].astype(float)).tolist()
    return model


def score_documents(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, score, lines (P(good) of each line with a word, in order).

    Null, empty and blank texts have no line and score 0. Texts are read whole; repeated rows score alike; other
    columns, labels and ids among them, aren't inputs. No shuffle.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for part in slices(batches):
            texts = part.column(1).to_pylist()
            p, _, at = held.value.lines(texts)
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(p.astype(np.float32)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(held.value.score(texts)), lists], names=["doc_id", "score", "lines"])

    return keyed_texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, lines array<float>")


def with_score(docs: DataFrame, model: QualityModel, name: str, text_col: str = "text") -> DataFrame:
    """The table itself with a column `name` of scores."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        table = pa.RecordBatch.from_arrays([texts, texts], names=["a", "b"])
        parts = [held.value.score(p.column(1).to_pylist()) for p in slices(iter([table]))]
        return pa.array(np.concatenate(parts) if parts else np.empty(0))

    return docs.withColumn(name, score(F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))))


def op4_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = score_documents(docs, train(docs, labels))
    return out.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
