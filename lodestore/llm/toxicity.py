"""Toxic spans from a CRF over words, and toxic documents from its marginals.

Only documents are labelled, so the words' labels are latent: expectation-maximisation under the rule that a toxic
document has a toxic word and a clean one has none.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestore.llm.crf import Crf, emissions, fit, logistic, sigmoid
from lodestore.llm.labelled import held_out, sample
from lodestore.llm.text import keyed_texts, slices

#: Documents labelled 0 and 1 that the model is fitted on at most.
TRAIN_EACH = (2000, 1200)
THRESHOLD = 0.7
#: Hashed features; prefixes of these lengths in bytes stand for a word's stem.
BITS, PREFIXES = 17, (4, 5, 6, 7, 8)
#: Rounds of expectation-maximisation, and documents in which a stem must stand to count at the start: at least so
#: many, this share of the toxic ones, and more than chance gives any stem in toxic ones alone with this probability.
ROUNDS, LEAST_DOCUMENTS, LEAST_SHARE, CHANCE = 2, 3, 0.01, 0.01
#: A word starts as toxic by its best stem's share if that is over this.
FIRST_SHARE = 0.8
#: Steps of a round's fit, which goes on from the last one's.
STEPS, RATE = 40, 1.0
#: The share of documents that may be called toxic without a toxic word.
MISLABELLED = 0.05
#: Parts of the labelled texts that are held back in turn, more of them where a label has fewer texts than MANY, and
#: standard errors by which their evidence must tell the labels apart.
FOLDS, FOLDS_OF_FEW, MANY, SURE = 2, 5, 100, 3.0
#: Words whose score a worker remembers at most.
CACHE = 200_000
_EDGE = b".,;:!?\"'()[]{}*_-#$%&|<>"
_WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def stems(word: bytes) -> list[bytes]:
    """What stands for a word: itself, lower-cased and without punctuation at its ends, and its prefixes."""
    core = word.strip(_EDGE).lower()
    return [b"=" + core] + [b"^" + core[:n] if len(core) > n else b"" for n in PREFIXES]


def indices(word: bytes) -> list[int]:
    return [zlib.crc32(s) & ((1 << BITS) - 1) if s else 1 << BITS for s in stems(word)] + [(1 << BITS) + 1]


class _Scores(dict):
    """Emission score of a word, computed once; forgets all when full."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: bytes) -> float:
        if len(self) >= CACHE:
            self.clear()
        w = self.weights
        out = self[word] = float(sum(w[i] for i in indices(word)))
        return out


@dataclass
class ToxicModel:
    crf: Crf
    weights: np.ndarray

    def marginals(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """P(toxic) of each word of each text, and where texts begin."""
        return self.of_words([t.split() for t in texts])

    def of_words(self, words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        scores = self.__dict__.get("scores")
        if scores is None:
            scores = self.scores = _Scores(self.crf.weights)
        at = np.zeros(len(words) + 1, np.int64)
        np.cumsum([len(w) for w in words], out=at[1:])
        e = np.fromiter((s for w in words for s in map(scores.__getitem__, w)), float, int(at[-1]))
        return self.crf.marginals(e, at), at

    def evidence(self, p: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of each text: the log-odds that some word is toxic, as if words were independent given their marginals, and the log of the expected share of toxic words."""
        total = np.concatenate([[0.0], np.cumsum(-np.log1p(-np.clip(p, 0, 1 - 1e-9)))])
        clean = np.clip(total[at[1:]] - total[at[:-1]], 1e-6, 12.0)
        mass = np.concatenate([[0.0], np.cumsum(p)])
        share = (mass[at[1:]] - mass[at[:-1]]) / np.maximum(np.diff(at), 1)
        return np.stack([np.log(np.expm1(clean)), np.log(np.clip(share, 1e-6, 1.0))], axis=1)

    def of(self, p: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.where(np.diff(at) > 0, sigmoid(self.evidence(p, at) @ self.weights[:2] + self.weights[2]), 0.0)

    def __getstate__(self):
        return {"crf": self.crf, "weights": self.weights}


def _few_copies(texts: list[bytes], y: list[int]) -> tuple[list[bytes], np.ndarray]:
    """One text of each group that shares the least hash of its three-word windows and its label: copies mustn't outvote."""
    seen, out = set(), ([], [])
    for t, v in zip(texts, y, strict=True):
        w = t.split()
        key = (v, min((zlib.crc32(b" ".join(w[i : i + 3])) for i in range(max(len(w) - 2, 1))), default=0))
        if key not in seen:
            seen.add(key)
            out[0].append(t)
            out[1].append(v)
    return out[0], np.array(out[1], np.int64)


def train(docs: DataFrame, labels: DataFrame, modulus: int = 3, remainder: int = 1, each: tuple[int, int] = TRAIN_EACH, id_col: str = "doc_id", text_col: str = "text") -> ToxicModel:
    """Fit on a bounded sample. Without both labels every text that isn't empty scores 0.5.

    At first a word of a toxic document is toxic as far as its best stem is more frequent in toxic documents than in
    clean ones. Then the CRF is fitted to these shares, and its marginals, given that a toxic document has a toxic word,
    are the next ones. Stems of fewer than LEAST_DOCUMENTS documents aren't learned.
    """
    texts, y = sample(docs, labels, "toxic", modulus, remainder, each, id_col, text_col)
    return learn(*_few_copies(texts, y))


def _word_crf(words: list[list[bytes]], y: np.ndarray) -> Crf:
    """The CRF of documents' words, given both labels."""
    size = (1 << BITS) + 2
    stood, count, total = (Counter(), Counter()), (Counter(), Counter()), [1, 1]
    for w, v in zip(words, y.tolist(), strict=True):
        of = Counter(s for x in w for s in stems(x) if len(s) > 2)
        stood[v].update(of.keys())
        count[v].update(of)
        total[v] += len(w)
    least = max(LEAST_DOCUMENTS, LEAST_SHARE * y.sum(), np.log(max(len(stood[1]), 1) / CHANCE) / np.log(len(y) / y.sum()))
    extra = {s: 1 - ((count[0][s] + 1) / total[0]) / (n / total[1]) for s, n in count[1].items() if stood[1][s] >= least}
    known = {x: i for i, x in enumerate(dict.fromkeys(x for w in words for x in w))}
    often = {s for s in stood[0].keys() | stood[1].keys() if stood[0][s] + stood[1][s] >= LEAST_DOCUMENTS}
    rows = np.array([[i if s in often else 1 << BITS for i, s in zip(indices(x), [*stems(x), b""], strict=True)][:-1] + [(1 << BITS) + 1] for x in known], np.int32).reshape(len(known), len(PREFIXES) + 2)
    share = np.array([max((extra.get(s, 0.0) for s in stems(x)), default=0.0) for x in known])
    kind, lens = np.fromiter((known[x] for w in words for x in w), np.int32), np.array([len(w) for w in words])
    some = lens > 0
    starts, of = np.concatenate([[0], np.cumsum(lens[some])]), np.repeat(y[some], lens[some])
    r = np.where(share > FIRST_SHARE, share, 0.0)[kind] * of
    start = np.zeros(size)
    start[-1] = np.log((r.sum() + 0.5) / (len(r) - r.sum() + 0.5))
    crf = Crf(start, np.zeros((2, 2)))
    for _ in range(ROUNDS if len(kind) else 0):
        crf = fit(rows, r, starts, size, steps=STEPS, rate=RATE, kind=kind, start=crf)
        p = crf.marginals(emissions(crf.weights, rows)[kind], starts)
        none = np.concatenate([[0.0], np.cumsum(np.log1p(-np.clip(p, 0, 1 - 1e-9)))])
        any_ = MISLABELLED - np.expm1(none[starts[1:]] - none[starts[:-1]])
        r = np.minimum(p / np.repeat(any_, lens[some]), 1.0) * of
    return crf


def separates(score: np.ndarray, y: np.ndarray) -> bool:
    """Whether label 1 scores higher than chance would have it: Wilcoxon's rank sum lies SURE standard errors above its mean."""
    n1 = int(y.sum())
    n0 = len(y) - n1
    if not n0 or not n1:
        return False
    values, at, times = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(times) - (times - 1) / 2)[at]
    above = rank[y == 1].sum() - n1 * (n1 + 1) / 2
    return above - n0 * n1 / 2 > SURE * np.sqrt(n0 * n1 * (len(y) + 1) / 12)


def learn(texts: list[bytes], y: np.ndarray) -> ToxicModel:
    """The model of texts and their labels.

    The scale that turns evidence into a probability is fitted on evidence of held-back texts: each fold's is taken by a
    CRF fitted on the other folds, since texts that a CRF has seen lie further apart than any it will meet. Where that
    evidence doesn't separate the labels (few toxic texts, or no words of their own), every text scores the share of
    toxic ones.
    """
    model = ToxicModel(Crf(np.zeros((1 << BITS) + 2), np.zeros((2, 2))), np.zeros(3))
    one: dict[bytes, bytes] = {}
    words = [[one.setdefault(x, x) for x in t.split()] for t in texts]  # a word is held once, however often it stands
    keep = [i for i, w in enumerate(words) if w]
    words, y = [words[i] for i in keep], np.asarray(y, np.int64)[keep]
    rare = min(int(y.sum()), int(len(y) - y.sum()))
    if not rare:
        return model
    model.weights = np.array([0.0, 0.0, np.log(y.sum() / (len(y) - y.sum()))])
    fold, folds = np.zeros(len(y), np.int64), min(FOLDS if rare >= MANY else FOLDS_OF_FEW, rare)
    for v in (0, 1):
        fold[y == v] = np.arange(int((y == v).sum())) % folds
    if rare > 1:
        held = np.zeros((len(y), 2))
        for k in range(folds):
            part = ToxicModel(_word_crf([w for w, f in zip(words, fold, strict=True) if f != k], y[fold != k]), np.zeros(3))
            held[fold == k] = part.evidence(*part.of_words([w for w, f in zip(words, fold, strict=True) if f == k]))
        weights = logistic(held, y.astype(float))
        if separates(held @ weights[:2], y):
            model.crf, model.weights = _word_crf(words, y), weights
    return model


def spans(text: bytes, p: np.ndarray, least: float = 0.5) -> list[dict]:
    """Runs of words at or above the marginal: byte offsets in the text, and the run's largest marginal."""
    out: list[dict] = []
    if not (p >= least).any():
        return out
    follows = False
    for m, x in zip(_WORD.finditer(text), p.tolist(), strict=True):
        if x >= least:
            if follows:
                out[-1]["end"], out[-1]["p"] = m.end(), max(out[-1]["p"], x)
            else:
                out.append({"start": m.start(), "end": m.end(), "p": x})
        follows = x >= least
    return out


def tag_documents(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, score, spans (byte offsets start and end, and p).

    Null, empty and blank texts have no span and score 0. Texts are read whole; repeated rows score alike; other
    columns aren't inputs. No shuffle.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for part in slices(batches):
            texts = part.column(1).to_pylist()
            p, at = held.value.marginals(texts)
            found = [spans(t, p[a:b]) for t, a, b in zip(texts, at[:-1], at[1:], strict=True)]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(held.value.of(p, at)), pa.array(found, kind)], names=["doc_id", "score", "spans"])

    return keyed_texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, spans array<struct<start: long, end: long, p: double>>")


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = tag_documents(docs, train(docs, labels))
    return out.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
