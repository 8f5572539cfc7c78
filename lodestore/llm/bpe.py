"""Byte-level BPE with a rank queue: merges of many pre-tokens are drained in rank order through a bitmap hierarchy."""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestore.llm.text import Memory, slices

#: Pieces of text of a generation that a worker remembers at most, and token pairs.
CACHE, PAIRS = 300_000, 1_000_000
#: Bytes of text that are encoded at once.
SLICE = 1 << 21
#: A blank next to a space: only there may a pre-token depend on more than the text from one space to the next.
_TANGLED = re.compile(r"\s[ ]|[ ]\s")


class RankQueue:
    """Buckets of positions by rank, and three levels of 64-bit words that tell which buckets hold something."""

    def __init__(self, ranks: int):
        self.buckets: dict[int, list[int]] = {}
        self.low = [0] * (ranks // 64 + 1)
        self.mid = [0] * (ranks // 4096 + 1)
        self.top = 0

    def push(self, rank: int, position: int) -> None:
        held = self.buckets.get(rank)
        if held is not None:
            held.append(position)
        else:
            self.fill(rank, [position])

    def fill(self, rank: int, positions: list[int]) -> None:
        """Put positions into an empty bucket."""
        self.buckets[rank] = positions
        a, b = rank >> 6, rank >> 12
        self.low[a] |= 1 << (rank & 63)
        self.mid[b] |= 1 << (a & 63)
        self.top |= 1 << b

    def pop(self) -> tuple[int, list[int]] | None:
        """The least rank and all its positions from the left."""
        if not self.top:
            return None
        b = (self.top & -self.top).bit_length() - 1
        word = self.mid[b]
        a = b << 6 | (word & -word).bit_length() - 1
        word = self.low[a]
        rank = a << 6 | (word & -word).bit_length() - 1
        self.low[a] = word & (word - 1)
        if not self.low[a]:
            self.mid[b] &= self.mid[b] - 1
            if not self.mid[b]:
                self.top &= self.top - 1
        held = self.buckets.pop(rank)
        held.sort()
        return rank, held


class Bpe:
    """The merges of a rank file; encode_all() and decode() take and give whole texts."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = max(self.ranks.values()) + 1
        self.bytes_of: list[bytes] = [b""] * self.size
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)])
        self.first_pairs = np.array([[self.ranks.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)])
        self.split = regex.compile(pattern).findall
        self.spaced = pattern == public_tokenizers.PATTERN
        self.id_bytes = [np.int32(i).tobytes() for i in range(self.size)]
        self.token_array = pa.array(self.bytes_of, pa.large_binary())
        self.digit_array = pa.array([b"%d," % i for i in range(self.size)], pa.large_binary())
        self.parts, self.pieces = Memory(CACHE), Memory(CACHE)
        self.pairs: dict[int, int] = {}

    def _pair(self, key: int) -> int:
        """The rank of two tokens (left << 16 | right) put together, or -1."""
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        rank = self.pairs[key] = self.ranks.get(self.bytes_of[key >> 16] + self.bytes_of[key & 65535], -1)
        return rank

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece as little-endian int32 bytes.

        All pieces lie in one linked list, parted by gaps that no pair spans. The queue gives the least rank with its
        positions; one is stale if it no longer starts a pair of that rank. If a merge makes a pair of a lower rank,
        the bucket's rest goes back and that rank is next: so every piece merges in the order that it would alone.
        """
        if not pieces:
            return []
        lens = np.array([len(p) for p in pieces])
        data = np.frombuffer(b"".join(pieces), np.uint8)
        place = np.arange(len(data)) + np.repeat(np.arange(len(pieces)), lens)
        n = len(data) + len(pieces)
        ids, pair = np.full(n, -1), np.full(n, -1)
        ids[place] = self.byte_id[data]
        inner = np.flatnonzero(np.diff(place) == 1)
        pair[place[inner]] = self.first_pairs[data[inner], data[inner + 1]]
        order = np.argsort(pair, kind="stable")
        order = order[np.searchsorted(pair[order], 0) :]
        kinds, begin = np.unique(pair[order], return_index=True)
        queue = RankQueue(self.size)
        for rank, start, stop in zip(kinds.tolist(), begin.tolist(), [*begin[1:].tolist(), len(order)], strict=False):
            queue.fill(rank, order[start:stop].tolist())
        ids, pair = ids.tolist(), pair.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        known, seek, bucket, fill = self.pairs.get, self._pair, queue.buckets.get, queue.fill
        while (entry := queue.pop()) is not None:
            rank, held = entry
            above = rank << 16
            for at, i in enumerate(held):
                if pair[i] != rank:
                    continue
                j = after[i]
                k = after[j]
                ids[i], ids[j], pair[j], after[i], before[k] = rank, -1, -1, k, i
                lower, new = False, -1
                if (follower := ids[k]) >= 0:
                    new = known(above | follower)
                    if new is None:
                        new = seek(above | follower)
                    if new >= 0:
                        if (its := bucket(new)) is not None:
                            its.append(i)
                        else:
                            fill(new, [i])
                        lower = new < rank
                pair[i] = new
                h = before[i]
                if h >= 0 and (leader := ids[h]) >= 0:
                    new = known(leader << 16 | rank)
                    if new is None:
                        new = seek(leader << 16 | rank)
                    pair[h] = new
                    if new >= 0:
                        if (its := bucket(new)) is not None:
                            its.append(h)
                        else:
                            fill(new, [h])
                        lower = lower or new < rank
                if lower and at + 1 < len(held):
                    fill(rank, held[at + 1 :])
                    break
        left = np.array(ids, np.int32)
        ends = 4 * np.cumsum(left >= 0)[np.cumsum(lens + 1) - 1]
        flat = left[left >= 0].tobytes()
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def encode_all(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in order, and where each text's begin (one more at the end).

        A text is looked up from space to space where that can't change its pre-tokens, else by pre-token; what isn't
        known yet is merged in one queue.
        """
        parts, codes, at = self._parts(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        each = self.parts.recall(parts)
        new = list(dict.fromkeys(p for p, v in zip(parts, each, strict=True) if v is None))
        if new:
            found = self._encoded(new)
            self.parts.keep(found)
            each = [found[p] if v is None else v for p, v in zip(parts, each, strict=True)]
        flat = np.frombuffer(b"".join(each), np.int32)
        lens = np.fromiter(map(len, each), np.int64, len(each)) >> 2
        begin, n = np.cumsum(lens) - lens, lens[codes]
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])
        return flat[np.repeat(begin[codes] - ends[:-1], n) + np.arange(ends[-1])], ends[at]

    def _encoded(self, parts: list[str]) -> dict[str, bytes]:
        """The ids of each new part. A part of one pre-token is merged at once, those of others are remembered as well."""
        one: dict[str, bytes] = {}
        several: dict[str, list[bytes]] = {}
        for p in parts:
            if self.spaced and p.isascii() and p[p[:1] == " " :].isalpha():
                one[p] = p.encode()
            else:
                several[p] = [t.encode() for t in self.split(p)]
        pieces = list(dict.fromkeys(chain.from_iterable(several.values())))
        ids = dict(zip(pieces, self.pieces.recall(pieces), strict=True))
        missing = [t for t, v in ids.items() if v is None]
        known = self.ranks.get
        made = {t: self.id_bytes[known(t)] for t in chain(missing, one.values()) if t in self.ranks}
        rest = list(dict.fromkeys(t for t in chain(missing, one.values()) if t not in made))
        made.update(zip(rest, self.merge(rest), strict=True))
        self.pieces.keep({t: made[t] for t in missing})
        ids.update((t, made[t]) for t in missing)
        return {p: made[t] for p, t in one.items()} | {p: b"".join(map(ids.__getitem__, row)) for p, row in several.items()}

    def _parts(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct parts, the texts' parts as places in them, and where each text's parts begin (one more at the end).

        Texts are cut at spaces only under the pattern for which that is known to keep all pre-tokens.
        """
        plain = pa.array([self.spaced and not _TANGLED.search(t) for t in texts.to_pylist()], pa.bool_())
        cut = pc.split_pattern(texts.filter(plain), " ")
        words = cut.flatten().dictionary_encode()
        heads = np.diff(cut.offsets.to_numpy()).astype(np.int64)
        first = np.cumsum(heads) - heads
        parts = [" " + w for w in words.dictionary.to_pylist()]
        codes = words.indices.to_numpy().astype(np.int64)
        opening = words.dictionary.take(words.indices.take(pa.array(first))).to_pylist()
        codes[first] = len(parts) + np.arange(len(first))
        parts += opening
        tangled = [self.split(t) for t in texts.filter(pc.invert(plain)).to_pylist()]
        if not tangled:
            return parts, codes, np.append(first, len(codes))
        own = {t: len(parts) + i for i, t in enumerate(dict.fromkeys(chain.from_iterable(tangled)))}
        parts += own
        is_plain = plain.to_numpy(zero_copy_only=False)
        size = np.empty(len(texts), np.int64)
        size[is_plain], size[~is_plain] = heads, [len(t) for t in tangled]
        both = np.empty(int(size.sum()), np.int64)
        of_plain = np.repeat(is_plain, size)
        both[of_plain], both[~of_plain] = codes, [own[t] for t in chain.from_iterable(tangled)]
        return parts, both, np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])

    def strings(self, ids: np.ndarray, ends: np.ndarray, of: pa.Array) -> list[memoryview]:
        """What stands for each text's ids in a binary array by id, put together."""
        taken = of.take(pa.array(ids))
        if not len(ids):
            return [memoryview(b"")] * (len(ends) - 1)
        at = np.frombuffer(taken.buffers()[1], np.int64)[: len(ids) + 1][ends].tolist()
        data = memoryview(taken.buffers()[2] or b"")
        return [data[a:b] for a, b in zip(at, at[1:], strict=False)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def loaded(path: str, pattern: str) -> Bpe:
    """One encoder a worker."""
    return Bpe(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, ids array<int>. Special tokens are ordinary text; a null or empty text has no ids.

    Any pattern whose matches cover the text will do; texts are cut at spaces first under public_tokenizers.PATTERN only.
    """

    def lists(bpe: Bpe, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids, pa.int32()))

    return _mapped(docs, id_col, text_col, lists, path, pattern, "ids array<int>")


def decode_documents(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per document: doc_id, text binary (the bytes of its ids in order; UTF-8 if the ids were whole texts')."""

    def run(batches):
        bpe = loaded(path, public_tokenizers.PATTERN)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.decode(x or []) for x in b.column(1).to_pylist()], pa.binary())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).alias("doc_id"), ids_col).mapInArrow(run, "doc_id long, text binary")


def round_trip(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, by encoding each whole text and decoding its ids.

    Null and empty texts have no tokens and the digest of nothing; repeated rows give repeated results; other columns
    aren't read. No shuffle; a worker holds one slice of texts and a bounded memory of pieces.
    """

    def digests(texts: list[memoryview]) -> pa.Array:
        return pa.array([hashlib.sha256(t).hexdigest() for t in texts])

    def run(bpe: Bpe, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        listed = [t[:-1] for t in bpe.strings(ids, ends, bpe.digit_array)]
        decoded = bpe.strings(ids, ends, bpe.token_array)
        return pa.StructArray.from_arrays([pa.array(np.diff(ends)), digests(listed), digests(decoded)], ["n_tokens", "ids_sha256", "decoded_sha256"])

    return _mapped(docs, id_col, text_col, run, path, pattern, "x struct<n_tokens: long, ids_sha256: string, decoded_sha256: string>").select("doc_id", "x.*")


def _mapped(docs: DataFrame, id_col: str, text_col: str, of, path: str, pattern: str, schema: str) -> DataFrame:
    name = schema.split()[0]

    def run(batches):
        bpe = loaded(path, pattern)
        collecting = gc.isenabled()
        gc.disable()  # nothing here makes cycles, and walking the memory of pieces costs a tenth of the time
        try:
            for part in slices(batches, most=SLICE):
                yield pa.RecordBatch.from_arrays([part.column(0), of(bpe, *bpe.encode_all(part.column(1)))], names=["doc_id", name])
        finally:
            if collecting:
                gc.enable()

    t = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return t.mapInArrow(run, f"doc_id long, {schema}")


def op3_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
