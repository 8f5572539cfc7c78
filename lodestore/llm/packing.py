"""Packing of documents into fixed-length sequences by a grouping genetic algorithm on islands."""

from __future__ import annotations

import json
import random
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestore.llm.text import slices
from lodestore.plans.staging import stage, unstage

CAPACITY, END = 1024, 2
#: Pieces of one genetic run; more pieces make more blocks, never larger ones.
BLOCK_PIECES = 4000
ISLANDS, EPOCHS, POPULATION, CHILDREN = 2, 2, 4, 16
#: A bin with this many free tokens at most is final; the others' pieces meet again in the next round's blocks.
SPARE = 0
#: A round that places less than one in so many of its pieces is the last, however many blocks it has.
WORTHWHILE = 4


@lru_cache(maxsize=2)
def _encoder(path: str):
    """The byte-level BPE of a tokenizers file: its vocabulary as ranks, in merge order, and its special tokens."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    special = {t["content"]: t["id"] for t in made["added_tokens"]}
    letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in letters} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in letters)}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in made["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def token_ids(texts: list[str], path: str) -> list[np.ndarray]:
    """The ids of each whole text, as the file's tokenizer gives them without adding special tokens: those that a text spells out keep their ids."""
    encode = _encoder(path).encode_to_numpy
    return [np.asarray(encode(t, allowed_special="all"), np.uint32) for t in texts]


def cut(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and the end id, cut only if longer than a sequence; the first piece takes the odd length."""

    def run(batches):
        for part in slices(batches):
            rows: list[tuple] = []
            for doc, ids in zip(part.column(0).to_pylist(), token_ids(part.column(1).to_pylist(), path), strict=True):
                ids = np.append(ids, np.uint32(end)).astype("<u4")
                first = (len(ids) - 1) % capacity + 1
                edges = [0, *range(first, len(ids) + 1, capacity)]
                rows.extend((doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)))
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    t = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return t.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


Bins = list[list[int]]


def best_fit(items: list[int], size: list[int], bins: Bins, capacity: int) -> Bins:
    """Put the items, in their order, each into the fullest bin that holds it; free lengths are bits of one integer."""
    free = [capacity - sum(size[i] for i in b) for b in bins]
    holders: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0
    for b, f in enumerate(free):
        if f:
            holders[f].append(b)
            some |= 1 << f
    for i in items:
        s = size[i]
        fits = some >> s
        if fits:
            f = s + (fits & -fits).bit_length() - 1
            b = holders[f].pop()
            if not holders[f]:
                some ^= 1 << f
            bins[b].append(i)
        else:
            b, f = len(bins), capacity
            bins.append([i])
        f -= s
        if f:
            holders[f].append(b)
            some |= 1 << f
    return bins


def _fitness(bins: Bins, size: list[int]) -> tuple[int, int]:
    return len(bins), -sum(sum(size[i] for i in b) ** 2 for b in bins)


def crossover(mother: Bins, father: Bins, size: list[int], capacity: int, rng: random.Random) -> Bins:
    """A child: the father's well-filled bins go in whole where they break none of the mother's, or sometimes one.

    The mother's bins that hold one of their pieces are opened, as are some or all of those not well filled; the
    pieces so displaced are placed by best fit, the largest first but for a random blur.
    """
    full = [sum(size[i] for i in b) >= capacity - SPARE for b in mother]
    home = {i: k for k, b in enumerate(mother) for i in b}
    given = []
    for b in father:
        if sum(size[i] for i in b) >= capacity - SPARE:
            broken = {home[i] for i in b if full[home[i]]}
            if not broken or (len(broken) == 1 and rng.random() < 0.3):
                given.append(list(b))
    taken = {i for b in given for i in b}
    share = rng.choice((0.3, 1.0, 1.0))
    kept, loose = [], []
    for k, b in enumerate(mother):
        if any(i in taken for i in b) or (not full[k] and rng.random() < share):
            loose.extend(i for i in b if i not in taken)
        else:
            kept.append(list(b))
    blur = rng.choice((0, capacity // 64, capacity // 16, capacity // 5))
    loose.sort(key=lambda i: -size[i] - rng.uniform(0, blur))
    return best_fit(loose, size, given + kept, capacity)


def evolve(size: list[int], elites: list[Bins], capacity: int, seed: int) -> Bins:
    """The best packing an island finds from its elites and best-fit starts."""
    rng = random.Random(seed)
    order = sorted(range(len(size)), key=lambda i: -size[i])
    people = [*elites]
    while len(people) < POPULATION:
        blur = 0 if not people else capacity // 8
        people.append(best_fit(sorted(order, key=lambda i: -size[i] - rng.uniform(0, blur)), size, [], capacity))
    people = sorted(((_fitness(p, size), p) for p in people), key=lambda x: x[0])
    least = max(-(-sum(size) // capacity), sum(2 * x > capacity for x in size))
    for _ in range(CHILDREN):
        if people[0][0][0] <= least:
            break
        mother, father = rng.sample(people, 2)
        child = crossover(mother[1], father[1], size, capacity, rng)
        people = sorted([*people, (_fitness(child, size), child)], key=lambda x: x[0])[: max(2, POPULATION)]
    return people[0][1]


def _start(capacity: int):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("uid", ignore_index=True)
        return _told(pdf, evolve(pdf.length.tolist(), [], capacity, int(key[0]) * ISLANDS + int(key[1])))

    return run


def _told(pdf: pd.DataFrame, bins: Bins) -> pd.DataFrame:
    of = np.empty(len(pdf), np.int64)
    for k, b in enumerate(bins):
        of[b] = k
    return pdf[["block", "island", "uid", "length"]].assign(bin=of)


def _again(capacity: int):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        """An island goes on from its own elite and the one that came from its neighbour."""
        elites = []
        for _, one in pdf.groupby("home", sort=True):
            one = one.sort_values("uid", ignore_index=True)
            elites.append([g.tolist() for g in one.groupby("bin", sort=True).indices.values()])
        return _told(one.assign(island=key[1]), evolve(one.length.tolist(), elites, capacity, int(key[0]) * ISLANDS + int(key[1]) + 10**6))

    return run


def _settled(capacity: int, last: bool):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        """The best island's bins: sequence and offset for full ones (all, in the last round), else neither."""
        fit = {}
        for island, one in pdf.groupby("island"):
            fill = one.groupby("bin").length.sum()
            fit[island] = (len(fill), -int((fill**2).sum()), island)
        one = pdf[pdf.island == min(fit, key=fit.get)].sort_values(["bin", "uid"], ignore_index=True)
        fill = one.groupby("bin").length.transform("sum")
        done = pd.Series(True, one.index) if last else fill >= capacity - SPARE
        offset = one.groupby("bin").length.cumsum() - one.length
        return pd.DataFrame({"uid": one.uid, "length": one.length, "sequence_id": one.groupby("bin").uid.transform("min").where(done).astype("Int64"), "offset": offset.where(done).astype("Int64")})

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, block: int = BLOCK_PIECES) -> DataFrame:
    """(uid, sequence_id, offset) for pieces (uid, length <= capacity): as few sequences as the search finds.

    Pieces fall into blocks of about `block` by a hash of their uid. Each block evolves on ISLANDS islands, which are
    Spark groups of their own; between epochs each island's elite also goes to its neighbour. Full bins are final; the
    pieces of the others are dealt into new blocks of the same size, as many as they need, until one block is left or
    a round fills hardly any bin: then all bins of the next round are final, in each of its blocks, at the cost of one
    bin a block that may stay open.
    """
    size, rest, done, turn = "block long, island int, uid long, length long, bin long", pieces.select("uid", "length"), [], 0
    n, last = rest.count(), False
    while True:
        blocks = max(1, round(n / block))
        t = rest.withColumn("block", F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(blocks))).withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])))
        now = stage(t.groupBy("block", "island").applyInPandas(_start(capacity), size), "island")
        for _ in range(EPOCHS - 1):
            guests = now.withColumn("home", F.col("island")).withColumn("island", F.explode(F.array("island", ((F.col("island") + 1) % ISLANDS).cast("int"))))
            then = stage(guests.groupBy("block", "island").applyInPandas(_again(capacity), size), "island")
            unstage(now)
            now = then
        last = last or blocks == 1
        out = stage(now.groupBy("block").applyInPandas(_settled(capacity, last), "uid long, length long, sequence_id long, offset long"), "packed")
        unstage(now)
        done.append(out.where("sequence_id is not null").select("uid", "sequence_id", "offset"))
        if last:
            break
        rest, turn = out.where("sequence_id is null").select("uid", "length"), turn + 1
        left = rest.count()
        if not left:
            break
        n, last = left, (n - left) * WORTHWHILE < n
    union = done[0]
    for d in done[1:]:
        union = union.union(d)
    return union


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is its end id alone. Rows with a null or repeated id are documents of their own. Other columns
    aren't read. A table without rows gives none. Texts are tokenised once and whole; only lengths are shuffled.
    """
    pieces = stage(cut(docs, path, capacity, end, id_col, text_col).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    whole = pieces.where(F.col("length") == capacity).withColumn("sequence_id", F.col("uid")).withColumn("offset", F.lit(0).cast("long"))
    part = pieces.where(F.col("length") < capacity)
    placed = part.join(pack(part, capacity), "uid")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return whole.select(columns).union(placed.select(columns))


def op7_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
