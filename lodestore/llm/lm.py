"""Language-model scores from a log-frequency Bloom filter of n-gram counts, beside an exact unigram base.

All pairs and triples of tokens enter the filter, those seen once too; it has as many segments as its entries need.
The most frequent n-grams also stand in a near part of fixed size that is broadcast; probes that it doesn't settle go
to their segments, and the levels found come back to the texts.
"""

from __future__ import annotations

import gc
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestore.llm.labelled import held_out
from lodestore.llm.text import GOLDEN, U, keyed_texts, mix, slices
from lodestore.plans.staging import stage

#: Bits to an entry, and 64-bit words of the near part (8 MiB).
BITS_EACH, NEAR_WORDS = 12, 1 << 20
#: Level from which an n-gram may stand in the near part, and the parts in which that is built.
NEAR_LEVEL, NEAR_PARTS = 5, 16
#: Exact counts of at most this many frequent tokens are broadcast (16 MiB); the others' are looked up by segment.
FREQUENT = 1 << 20
#: Bytes of training text that are counted together, of texts that are scored together, and of training text to a segment.
COUNTED, SLICE, SEGMENT = 1 << 24, 1 << 22, 1 << 22
#: Bytes of text whose probes one copy of a segment answers.
ANSWERED = 1 << 23
#: What an n-gram's context counts for the next lower order, as if so many tokens had followed it in that order's shares.
TRUST = 16.0


def _edges() -> np.ndarray:
    out = [1]
    while out[-1] < 1 << 50:
        out.append(max(out[-1] + 1, out[-1] * 7 // 5))
    return np.array(out, np.int64)


#: Least count of each level: 1, 2, 3, 4, 5, 7, 9, 12, ... A level holds counts within a factor of 1.4, and a count's level is below it, so the entries (one a level) are never more than the tokens.
EDGES = _edges()
#: The end of a text, as a token that no word equals, and what stands before a text's first token in triples.
_END, _START = xxhash.xxh3_64_intdigest(b"\n"), xxhash.xxh3_64_intdigest(b"\n\n")


def level(n: np.ndarray) -> np.ndarray:
    """The level of each count, -1 for 0."""
    return np.searchsorted(EDGES, n, "right") - 1


def least(lev: np.ndarray) -> np.ndarray:
    """The least count of each level, 0 for -1."""
    return np.where(lev < 0, 0, EDGES[np.maximum(lev, 0)])


def most(lev: np.ndarray) -> np.ndarray:
    """The largest count of each level, 0 for -1."""
    return EDGES[lev + 1] - 1


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' tokens, each text's last being the end token, and where texts begin (one more at the end)."""
    words = [t.lower().split() for t in texts]
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(w) + 1 for w in words], out=at[1:])
    h = np.full(int(at[-1]), U(_END))
    inner = np.ones(len(h), bool)
    inner[at[1:] - 1] = False
    h[inner] = np.fromiter((x for w in words for x in map(xxhash.xxh3_64_intdigest, w)), U, int(inner.sum()))
    return h, at


def _shifted(x: np.ndarray, first: int) -> np.ndarray:
    return np.concatenate([np.full(1, first, x.dtype), x[:-1]])


def grams(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the pair and of the triple that end at each token. The end token stands before a text's first token."""
    two = mix(h * U(GOLDEN) ^ mix(_shifted(h, _END) + U(1)))
    context = _shifted(two, _START)
    context[at[:-1]] = U(_START)
    return two, mix(h * U(GOLDEN) ^ mix(context + U(2)))


def segment_of(h: np.ndarray, segments: int) -> np.ndarray:
    return (((h >> U(32)) * U(segments)) >> U(32)).astype(np.uint16 if segments <= 1 << 16 else np.int32)


#: Four bits of a word, and the word that has them, by 16 bits of hash.
POSITIONS = (mix(np.arange(4 << 16, dtype=U) + U(1)) & U(63)).astype(np.int64).reshape(-1, 4)
MASKS = np.bitwise_or.reduce(U(1) << POSITIONS.astype(U), axis=1)


def _places(key: np.ndarray, lev: int, size: int) -> tuple[np.ndarray, ...]:
    """The two words of an entry (an n-gram at one level of its unary count), and which masks it has in them."""
    e = mix(key ^ U((lev + 1) * GOLDEN % 2**64))
    f = e * U(GOLDEN)
    one, two = (((x >> U(32)) * U(size) >> U(32)).astype(np.int64) for x in (e, f))
    return one, two, (e & U(65535)).astype(np.int64), (f >> U(8) & U(65535)).astype(np.int64)


def filter_words(key: np.ndarray, lev: np.ndarray, cut: int, size: int | None = None, bits_each: int = BITS_EACH) -> np.ndarray:
    """A blocked Bloom filter that holds each key at every level from the cut to its own, in `size` words or as many as its entries need."""
    if size is None:
        size = int((lev - cut + 1).clip(0).sum()) * bits_each // 64 + 1
    flags = np.zeros(size * 64, bool)
    for at in range(cut, int(lev.max(initial=cut - 1)) + 1):
        one, two, a, b = _places(key[lev >= at], at, size)
        for word, mask in ((one * 64, a), (two * 64, b)):
            for j in range(4):
                flags[word + POSITIONS[mask, j]] = True
    return np.packbits(flags, bitorder="little").view("<u8")


def probe(words: np.ndarray, key: np.ndarray, cut: int, size: int, part: np.ndarray | None = None) -> np.ndarray:
    """The level of each key, -1 for what isn't entered: levels are probed upwards from the cut until one isn't a member of its part (of `size` words)."""
    lev, at = np.full(len(key), -1, np.int8), cut
    here = np.arange(len(key))
    while len(here) and at < len(EDGES) - 1:
        one, two, a, b = _places(key, at, size)
        if part is not None:
            one, two = one + part, two + part
        a, b = MASKS[a], MASKS[b]
        hit = np.flatnonzero((words[one] & a == a) & (words[two] & b == b))
        here, key = here[hit], key[hit]
        part = None if part is None else part[hit]
        lev[here] = at
        at += 1
    return lev


@dataclass
class Model:
    """The near part, frequent tokens' exact counts and totals; `far` is the table of segments, not sent with the model."""

    words: np.ndarray
    cut: int
    tokens: np.ndarray
    counts: np.ndarray
    total: int
    kinds: int
    starts: int
    segments: int
    far: DataFrame | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"far": None}

    def exact(self, h: np.ndarray) -> np.ndarray:
        """Exact counts of frequent tokens, 0 for others."""
        if not len(self.tokens):
            return np.zeros(len(h), np.int64)
        i = np.minimum(np.searchsorted(self.tokens, h), len(self.tokens) - 1)
        return np.where(self.tokens[i] == h, self.counts[i], 0)

    def shares(self, n: np.ndarray, before: np.ndarray, pair: np.ndarray, triple: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each token's probability by itself, and after its two predecessors.

        n, before: exact counts of the token and the one before it; pair, triple: their levels, of which the least
        count is taken; context: the count of the two tokens before, by its level's largest count. An order gives
        TRUST tokens to the next lower one. All a context's followers have together at most what it has itself, so
        that probabilities sum to 1 at most over the known tokens and one unknown.
        """
        single = (n + 1) / (self.total + self.kinds + 1)
        two = (np.minimum(least(pair), before) + TRUST * single) / (before + TRUST)
        return single, (np.minimum(least(triple), context) + TRUST * two) / (context + TRUST)


def _dealt(segment: np.ndarray, *values: np.ndarray):
    """(segment, the bytes of its part of each array) for arrays in order of segment."""
    kinds, begin = np.unique(segment, return_index=True)
    ends = [*begin[1:].tolist(), len(segment)]
    for s, a, b in zip(kinds.tolist(), begin.tolist(), ends, strict=False):
        yield s, *(v[a:b].tobytes() for v in values)


def _counted(segments: int):
    def run(batches):
        """Distinct tokens, and distinct pairs and triples, of a slice with their counts, by segment. Of n-grams, 32 bits of hash stand beside it."""
        for part in slices(batches, most=COUNTED):
            h, at = tokens(part.column(1).to_pylist())
            for kind, x, width in ((1, h, U), (2, np.concatenate(grams(h, at)), np.uint32)):
                x, n = np.unique(x, return_counts=True)
                rows = list(zip(*_dealt(segment_of(x, segments), x.astype(width), n.astype(np.uint32)), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array([kind] * len(rows[0]), pa.int32()), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.binary())], names=["segment", "kind", "h", "n"])

    return run


def _summed(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and the sums of their counts."""
    order = np.argsort(h)
    h, n = h[order], n[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate([np.ones(min(len(h), 1), bool), h[1:] != h[:-1]]))
    return h[first], np.add.reduceat(n, first) if len(first) else n


_SEGMENT = "segment int, bits binary, tokens binary, counts binary, often array<long>, level array<byte>, spread array<long>, token_spread array<long>, total long"


def _segment(bits_each: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """One segment: its tokens with exact counts, the filter of its n-grams, its frequent n-grams, and how many of either are at each level."""
        of = []
        for kind, width in ((1, U), (2, np.uint32)):
            some = table.filter(pc.equal(table.column("kind"), kind))
            of.append(_summed(*(np.frombuffer(b"".join(some.column(c).to_pylist()), t) for c, t in (("h", width), ("n", np.uint32)))))
        (token, count), (h, n) = of
        lev, s = level(n), key[0].as_py()
        often = lev >= NEAR_LEVEL
        spread = [np.bincount(x, minlength=len(EDGES)).astype(np.int64) for x in (lev, level(count))]
        values = [s, filter_words(h.astype(U), lev, 0, bits_each=bits_each).tobytes(), token.tobytes(), count.tobytes(), (h[often].astype(U) | U(s << 32)).view(np.int64), lev[often].astype(np.int8), *spread, int(count.sum())]
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int8()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64()]
        return pa.table({f.split()[0]: pa.array([v], t) for f, v, t in zip(_SEGMENT.split(", "), values, kinds, strict=True)})

    return run


def _near(cut: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        words = filter_words(table.column("often").to_numpy().view(U), table.column("level").to_numpy().astype(np.int64), cut, NEAR_WORDS // NEAR_PARTS)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([words.tobytes()], pa.binary())})

    return run


def _frequent(least_count: int):
    def run(batches):
        """The tokens that often."""
        for batch in batches:
            for token, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h, n = np.frombuffer(token, np.int64), np.frombuffer(count, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h[n >= least_count]), pa.array(n[n >= least_count])], names=["h", "n"])

    return run


def _by_level(far: DataFrame, column: str) -> list[int]:
    found = {r[0]: r[1] for r in far.select(F.posexplode(column)).groupBy("pos").agg(F.sum("col")).collect()}
    return [found.get(i, 0) for i in range(len(EDGES))]


def train(docs: DataFrame, modulus: int = 7, remainder: int = 2, bits_each: int = BITS_EACH, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model of the documents that aren't held out.

    Each slice's distinct tokens, pairs and triples are counted, dealt by segment and summed there. N-grams are told
    apart by segment and 32 bits, which errs less often than the filter does.
    """
    kept = keyed_texts(docs.where(~held_out(id_col, modulus, remainder)), id_col, text_col)
    size, starts = kept.agg(F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0)), F.count("*")).first()
    segments = size // SEGMENT + 1
    counted = kept.mapInArrow(_counted(segments), "segment int, kind int, h binary, n binary")
    far = stage(counted.groupBy("segment").applyInArrow(_segment(bits_each), _SEGMENT), "segments")
    kinds, total = far.agg(F.coalesce(F.sum(F.octet_length("tokens").cast("long")), F.lit(0)) / 8, F.coalesce(F.sum("total"), F.lit(0))).first()
    spread, of_tokens = _by_level(far, "spread"), _by_level(far, "token_spread")
    often = next(c for c in range(len(EDGES)) if sum(of_tokens[c:]) <= FREQUENT)
    exact = far.select("tokens", "counts").mapInArrow(_frequent(int(EDGES[often])), "h long, n long").toArrow()
    token = exact.column(0).to_numpy().view(U)
    order = np.argsort(token)
    cut = next(c for c in range(NEAR_LEVEL, len(EDGES)) if sum((x - c + 1) * spread[x] for x in range(c, len(EDGES))) * BITS_EACH <= NEAR_WORDS * 64)
    hot = far.select(F.inline(F.arrays_zip("often", "level"))).where(F.col("level") >= cut)
    parts = hot.groupBy(F.col("often").bitwiseAND(F.lit(NEAR_PARTS - 1)).cast("int").alias("part")).applyInArrow(_near(cut), "part int, bits binary").toArrow()
    words = np.zeros((NEAR_PARTS, NEAR_WORDS // NEAR_PARTS), U)
    for p, b in zip(parts.column(0).to_pylist(), parts.column(1).to_pylist(), strict=True):
        words[p] = np.frombuffer(b, U)
    model = Model(words.reshape(-1), cut, token[order], exact.column(1).to_numpy()[order], int(total), int(kinds), int(starts), int(segments), far)
    # the shuffle of the counts isn't read again: Spark deletes its files once the driver has collected its plan
    del kept, counted, hot, parts, exact
    gc.collect()
    docs.sparkSession.sparkContext._jvm.System.gc()
    return model


_PACKED = "slice long, doc_ids array<long>, sizes array<long>, texts binary"


def _packed(batches):
    """Slices of texts as one compressed row each, numbered by partition and place, so that a repeated task gives the same ones."""
    at = TaskContext.get().partitionId() << 32
    for i, part in enumerate(slices(batches, most=SLICE)):
        texts = part.column(1).to_pylist()
        row = [at + i], [part.column(0).to_pylist()], [list(map(len, texts))], [zstandard.compress(b"".join(texts))]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()), strict=True)], names=["slice", "doc_ids", "sizes", "texts"])


def _texts(table: pa.Table) -> list[bytes]:
    sizes = table.column("sizes")[0].as_py()
    whole, ends = zstandard.decompress(table.column("texts")[0].as_py()), np.cumsum([0, *sizes]).tolist()
    return [whole[a:b] for a, b in zip(ends, ends[1:], strict=False)]


class _Slice:
    """What is known of a slice's tokens without the segments, and what is asked of them, in order of segment."""

    def __init__(self, model: Model, texts: list[bytes]):
        self.h, self.at = tokens(texts)
        kinds, self.kind = np.unique(self.h, return_inverse=True)
        self.count = model.exact(kinds)
        self.rare, self.rare_segment = self._ordered(np.flatnonzero(self.count == 0), kinds, model.segments)
        self.rare_tokens = kinds[self.rare]
        x, n = np.concatenate(grams(self.h, self.at)), len(self.h)
        self.level = np.full(2 * n, -1, np.int8)
        self._near(model, x, np.arange(n))
        self._near(model, x, n + np.flatnonzero(self.level[:n] >= 0))  # a triple isn't more frequent than its pair
        self.open, self.open_segment = self._ordered(np.flatnonzero(self.level < 0), x, model.segments)
        self.open_grams = x[self.open].astype(np.uint32)

    @staticmethod
    def _ordered(rows: np.ndarray, x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
        segment = segment_of(x[rows], segments)
        order = np.argsort(segment, kind="stable")
        return rows[order], segment[order]

    def _near(self, model: Model, x: np.ndarray, rows: np.ndarray) -> None:
        low = x[rows] & U(2**32 - 1)
        part = (low & U(NEAR_PARTS - 1)).astype(np.int64) * (NEAR_WORDS // NEAR_PARTS)
        self.level[rows] = probe(model.words, low | segment_of(x[rows], model.segments).astype(U) << U(32), model.cut, NEAR_WORDS // NEAR_PARTS, part)


def _asked(held):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """A slice's probes for each segment."""
        part = _Slice(held.value, _texts(table))
        rows = [(s, 0, b) for s, b in _dealt(part.open_segment, part.open_grams)] + [(s, 1, b) for s, b in _dealt(part.rare_segment, part.rare_tokens)]
        columns = list(zip(*rows, strict=True)) or [[], [], []]
        kinds = (pa.int32(), pa.int32(), pa.binary())
        return pa.table({"slice": pa.array([key[0].as_py()] * len(rows), pa.int64()), **{n: pa.array(c, t) for n, c, t in zip(("segment", "kind", "asked"), columns, kinds, strict=True)}})

    return run


def _answered(key: tuple, asked: pa.Table, segment: pa.Table) -> pa.Table:
    """The levels of n-grams (one more, as bytes) and the counts of rare tokens that a segment tells."""
    kind = asked.column("kind").to_numpy()
    blobs = asked.column("asked").to_pylist()
    out: list[bytes] = [b""] * len(blobs)
    for k, width, dtype in ((0, 4, np.uint32), (1, 8, U)):
        rows = np.flatnonzero(kind == k).tolist()
        x = np.frombuffer(b"".join(blobs[i] for i in rows), dtype)
        if k == 0:
            words = np.frombuffer(segment.column("bits")[0].as_buffer(), U) if segment.num_rows else np.zeros(1, U)
            answer = (probe(words, x.astype(U), 0, len(words)) + 1).astype(np.uint8)
        else:
            answer = np.zeros(len(x), np.int64)
            if segment.num_rows and len(known := np.frombuffer(segment.column("tokens")[0].as_buffer(), U)):
                i = np.minimum(np.searchsorted(known, x), len(known) - 1)
                answer = np.where(known[i] == x, np.frombuffer(segment.column("counts")[0].as_buffer(), np.int64)[i], answer)
        ends = np.concatenate([[0], np.cumsum([len(blobs[i]) // width for i in rows])]).tolist()
        for i, a, b in zip(rows, ends, ends[1:], strict=False):
            out[i] = answer[a:b].tobytes()
    return pa.table({c: asked.column(c) for c in ("slice", "segment", "kind")} | {"answer": pa.array(out, pa.binary())})


_SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _scored(held):
    def run(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        """The scores of a slice's texts from what its segments told."""
        model = held.value
        texts = _texts(table)
        part = _Slice(model, texts)
        answers = answers.sort_by("segment")
        kind, blobs = answers.column("kind").to_pylist(), answers.column("answer").to_pylist()
        part.level[part.open] = np.frombuffer(b"".join(b for k, b in zip(kind, blobs, strict=True) if k == 0), np.uint8).astype(np.int8) - 1
        part.count[part.rare] = np.frombuffer(b"".join(b for k, b in zip(kind, blobs, strict=True) if k == 1), np.int64)
        n, begin = part.count[part.kind], part.at[:-1]
        pair, triple = part.level[: len(n)], part.level[len(n) :]
        before, context = _shifted(n, 0), _shifted(most(pair), 0)
        before[begin] = context[begin] = model.starts
        single, share = model.shares(n, before, pair, triple, context)
        sums = [np.add.reduceat(x, begin) for x in ((n > 0).astype(np.int64), np.log10(single), np.log10(share))]
        return pa.table({"doc_id": pa.array(table.column("doc_ids")[0].as_py(), pa.int64()), "n_tokens": pa.array(np.diff(part.at)), "n_known": pa.array(sums[0]), "base_score": pa.array(sums[1]), "score": pa.array(sums[2])})

    return run


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, n_known, base_score, score.

    base_score is exact. score interpolates the filter's counts of triples and pairs with the exact ones of tokens.
    Texts are put together in slices of about SLICE bytes, which travel compressed; each probe that the near part leaves
    open goes to its segment in 32 bits, and a byte comes back. Null and empty texts are their end token. Repeated rows
    and null ids are rows of their own; a very long text is a slice of its own, scored whole; other columns aren't read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    t = keyed_texts(docs, id_col, text_col)
    size = t.agg(F.sum(F.length("text").cast("long") + 8)).first()[0] or 0
    packed = t.mapInArrow(_packed, _PACKED)
    copies = -(-size // (model.segments * ANSWERED)) or 1
    asked = packed.groupBy("slice").applyInArrow(_asked(held), "slice long, segment int, kind int, asked binary").withColumn("copy", F.pmod("slice", F.lit(copies)).cast("int"))
    far = model.far.select("segment", "bits", "tokens", "counts", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"))
    told = asked.groupBy("segment", "copy").cogroup(far.groupBy("segment", "copy")).applyInArrow(_answered, "slice long, segment int, kind int, answer binary")
    return packed.groupBy("slice").cogroup(told.groupBy("slice")).applyInArrow(_scored(held), _SCORES)


def op5_lm(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs)
    return score_documents(docs, model).select("*", F.lit(model.total).cast("long").alias("train_tokens"), held_out("doc_id", 7, 2).alias("held_out"))
