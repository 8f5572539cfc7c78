"""Near-duplicate documents by SuperMinHash signatures, banding, verification on full sets and union-find groups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestore.llm.text import GOLDEN, U, keyed_texts, longs, mix, shingle_sets, slices
from lodestore.operators.components import connected_components
from lodestore.plans.staging import stage, unstage

SHINGLE_WORDS, THRESHOLD = 5, 75
#: Bands of rows: a pair at similarity 0.75 shares no band with probability (1 - 0.75^4)^32 = 5e-6.
BANDS, ROWS = 32, 4
#: Texts and shingles of a block at most, on average; a task holds two.
BLOCK, BLOCK_SHINGLES = 1500, 2_000_000


def superminhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """The SuperMinHash signature (Ertl 2017) of each non-empty set, as a (sets, m) array of doubles.

    Each element walks its own random permutation of the m slots; at step j it offers rank j plus a uniform to its
    j-th slot, and a slot keeps the least. All sets walk together, one step at a time, and a set whose slots all hold
    less than the next rank stops early: later steps can't lower them.
    """
    x = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    best = np.full(len(sets) * m, np.inf)
    order = np.broadcast_to(np.arange(m, dtype=np.uint8), (len(x), m)).copy()
    for j in range(m):
        z = mix(x + U((j + 1) * GOLDEN % 2**64))
        r = (z >> U(11)).astype(np.float64) * 2.0**-53
        k = j + (((mix(z) >> U(32)) * U(m - j)) >> U(32)).astype(np.int64)
        row = np.arange(len(x))
        slot = order[row, k]
        order[row, k] = order[:, j]
        np.minimum.at(best, owner * m + slot, r + j)
        going = best.reshape(-1, m).max(axis=1) >= j + 1
        if not going.any():
            break
        keep = going[owner]
        if keep.sum() < 0.7 * len(x):
            x, owner, order = x[keep], owner[keep], order[keep]
    return best.reshape(-1, m)


def sketch_schema() -> str:
    return "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, signature binary"


def _sketch(k: int, bands: int, rows: int):
    def run(batches):
        m = bands * rows
        for part in slices(batches):
            sets = shingle_sets(part.column(1).to_pylist(), k)
            full = [i for i, s in enumerate(sets) if len(s)]
            keys, sign = [np.empty(0, U)] * len(sets), [b""] * len(sets)
            if full:
                s = superminhash([sets[i] for i in full], m).view(U)
                b = np.broadcast_to(np.arange(1, bands + 1, dtype=U) * U(GOLDEN), (len(full), bands))
                for r in range(rows):
                    b = mix(b ^ mix(s[:, r::rows] + U(r)))
                low = (mix(s) & U(255)).astype(np.uint8)
                for at, i in enumerate(full):
                    keys[i], sign[i] = b[at], low[at].tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(np.array([mix(s).sum(dtype=U) for s in sets], U).view(np.int64)),
                    pa.array(np.array([mix(s ^ U(0xA0761D6478BD642F)).sum(dtype=U) for s in sets], U).view(np.int64)),
                    longs(keys),
                    pa.array(sign, pa.binary()),
                ],
                names=["doc_id", "n_shingles", "set_a", "set_b", "bands", "signature"],
            )

    return run


def _sets(k: int):
    def run(batches):
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), longs(shingle_sets(part.column(1).to_pylist(), k))], names=["node", "items"])

    return run



def _lowered(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t.lower() for t in b.column(1).to_pylist()], pa.binary())], names=["doc_id", "text"])


def _chain(first, then):
    def run(batches):
        return then(first(batches))

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, threshold: int = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept; documents of one component are near copies.

    Sets are the distinct shingles of `words` A-Z-lowered words; documents link where 100 * intersection >=
    threshold * union. Sets are compared as 64-bit shingle hashes. Null and empty texts have no shingles and link with
    nothing. Rows of a null id link with nothing and are kept with a null component. Rows that share an id are one
    document: their links are pooled. Other columns, whatever their names, aren't read.

    Equal sets first become one class, so exact copies cost one sketch each and no pairs. In each band bucket the
    smallest id is then compared with the other members: a group of near copies costs a star. Buckets that still hold
    several components are compared in blocks of about BLOCK texts or BLOCK_SHINGLES shingles, pair of blocks by pair of
    blocks: first by signatures, so that only texts whose signature comes near one of another component send their
    sets; then a task tries every such pair that shares a bucket and isn't joined yet, and returns the links that join.
    So no link that could join two components is skipped, and no table of pairs grows with the square of a group. What
    is joined by bucket is staged on both sides, so that Spark can split a hot bucket's partition.
    """
    lowered = _chain(_lowered, _sketch(words, bands, rows))
    sk = stage(keyed_texts(docs, id_col, text_col).mapInArrow(lowered, sketch_schema()), "sketch")
    full = sk.where("n_shingles > 0 and doc_id is not null")
    classes = stage(full.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("cls")), "classes")
    of_class = full.join(classes, ["set_a", "set_b", "n_shingles"])
    reps = stage(of_class.where("doc_id = cls").select("cls", "n_shingles", "bands", "signature"), "representatives")
    copies = of_class.where("doc_id <> cls").select(F.col("doc_id").alias("a"), F.col("cls").alias("b"))

    spread = reps.select(F.explode("bands").alias("bucket"), "cls", F.col("n_shingles").alias("n"))
    shared = stage(spread.groupBy("bucket").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo < hi").select("bucket"), "shared")
    members = stage(spread.join(shared, "bucket", "left_semi"), "members")
    wanted = members.select(F.col("cls").alias("doc_id")).distinct()
    texts = keyed_texts(docs, id_col, text_col).join(wanted, "doc_id", "left_semi")
    sets = stage(texts.mapInArrow(_chain(_lowered, _sets(words)), "node long, items array<long>"), "sets")
    signs = reps.select(F.col("cls").alias("node"), "signature")

    # first, one leader a bucket against the other members: a star of pairs
    lead = stage(members.groupBy("bucket").agg(F.min(F.struct("cls", "n")).alias("l")).select("bucket", F.col("l.cls").alias("lead"), F.col("l.n").alias("lead_n")), "leaders")
    near_size = (F.col("n") * 100 >= F.col("lead_n") * threshold) & (F.col("lead_n") * 100 >= F.col("n") * threshold)
    pairs = members.join(lead, "bucket").where((F.col("cls") > F.col("lead")) & near_size).select(F.col("lead").alias("a"), F.col("cls").alias("b")).distinct()
    links = stage(_verified(pairs, signs, sets, threshold), "links")
    label = connected_components(links)

    # then, what shares a bucket and isn't joined yet, in blocks
    at = members.join(label, F.col("cls") == F.col("node"), "left").select("bucket", "cls", "n", F.coalesce("component", "cls").alias("part"))
    open_ = stage(at.groupBy("bucket").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("bucket"), "unsettled")
    at = stage(at.join(open_, "bucket", "left_semi"), "open")
    least = stage(at.groupBy("bucket").agg(F.min("cls").alias("least")), "least")
    near = connected_components(at.join(least, "bucket").select("cls", "least").distinct(), "cls", "least")
    more = _blocks(at.select("cls", "part", "n").distinct(), near, reps, sets, threshold)
    more = stage(more, "block-links")
    label = connected_components(copies.union(links).union(more))
    for t in (classes, reps, shared, members, lead, sets, links, open_, at, least, more):
        unstage(t)
    out = sk.select("doc_id", "n_shingles").join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _verified(pairs: DataFrame, signs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold.

    Pairs whose signatures agree in less than threshold - 25 of a hundred slots are dropped before the sets travel: at
    128 slots that is over six standard errors below the threshold.
    """
    a = signs.select(F.col("node").alias("a"), F.col("signature").alias("sa"))
    b = signs.select(F.col("node").alias("b"), F.col("signature").alias("sb"))
    agree = F.expr("size(filter(sequence(1, length(sa)), i -> substring(sa, i, 1) = substring(sb, i, 1))) * 100 / length(sa)")
    likely = pairs.join(a, "a").join(b, "b").where(agree >= threshold - 25).select("a", "b").distinct()
    a = sets.select(F.col("node").alias("a"), F.col("items").alias("xa"))
    b = sets.select(F.col("node").alias("b"), F.col("items").alias("xb"))
    both = likely.join(a, "a").join(b, "b").withColumn("common", F.size(F.array_intersect("xa", "xb")))
    union = F.size("xa") + F.size("xb") - F.col("common")
    return both.where(F.col("common") * 100 >= union * threshold).select("a", "b").distinct()


def _blocks(open_: DataFrame, near: DataFrame, reps: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Links (a, b) that join components among texts whose buckets chain them together.

    open_: (cls, part, n), part the component so far, n its shingles; near: (node, component) of those chains. A part of
    many texts has blocks of its own, which needn't be compared with each other.
    """
    t = open_.join(near.withColumnsRenamed({"node": "cls", "component": "chain"}), "cls")
    size = t.groupBy("chain", "part").agg(F.count("*").alias("count"), F.sum("n").alias("shingles")).withColumn("solo", F.col("count") * 4 >= BLOCK)
    own = F.when(F.col("solo"), F.col("part"))
    room = size.groupBy("chain", own.alias("own")).agg(F.greatest(F.ceil(F.sum("count") / BLOCK), F.ceil(F.sum("shingles") / BLOCK_SHINGLES)).alias("parts"))
    t = t.join(size.select("chain", "part", own.alias("own")), ["chain", "part"])
    t = t.join(room.withColumnsRenamed({"chain": "rc", "own": "ro"}), (F.col("chain") == F.col("rc")) & F.col("own").eqNullSafe(F.col("ro")))
    t = stage(t.select("cls", "part", "chain", "own", F.pmod(F.xxhash64("cls"), F.col("parts")).alias("k")), "blocks")
    blocks = t.groupBy("chain", "own", "k").count().select("chain", "own", "k", F.xxhash64("chain", "own", "k").alias("block"))
    a, b = blocks.select("chain", F.col("own").alias("oa"), F.col("block").alias("ba")), blocks.select("chain", F.col("own").alias("ob"), F.col("block").alias("bb"))
    twos = a.join(b, "chain").where("ba <= bb and not coalesce(oa = ob, false)").withColumn("pair", F.xxhash64("ba", "bb"))
    sides = twos.select("chain", F.col("ba").alias("block"), "pair", F.lit(0).alias("side")).union(twos.where("ba < bb").select("chain", F.col("bb").alias("block"), "pair", F.lit(1).alias("side")))
    t = t.withColumn("block", F.xxhash64("chain", "own", "k")).join(sides, ["chain", "block"]).select("pair", "side", "cls", "part")
    t = t.join(reps.select("cls", "n_shingles", "bands", "signature"), "cls")
    likely = stage(t.groupBy("pair").applyInArrow(_likely(threshold), "pair long, side int, cls long, part long, bands array<long>, signature binary"), "likely")
    return likely.join(sets.withColumnRenamed("node", "cls"), "cls").groupBy("pair").applyInArrow(_compared(threshold), "a long, b long")


def _ordered(table: pa.Table) -> tuple:
    """A pair of blocks, each text once a side, by side and id: the table, sides, ids, parts, signatures and bands."""
    t = table.combine_chunks()
    t = t.take(pa.array(np.lexsort((t.column("cls").to_numpy(), t.column("side").to_numpy())))).combine_chunks()
    t = t.filter(pa.array(np.concatenate([[True], (np.diff(t.column("cls").to_numpy()) != 0) | (np.diff(t.column("side").to_numpy()) != 0)]))).combine_chunks()
    side, ids, part = (t.column(c).to_numpy() for c in ("side", "cls", "part"))
    sign = np.frombuffer(b"".join(t.column("signature").to_pylist()), np.uint8).reshape(len(ids), -1)
    return t, side, ids, part, sign, np.array(t.column("bands").to_pylist(), np.int64)


def _partners(side: np.ndarray, part: np.ndarray, bands: np.ndarray, sign: np.ndarray, n: np.ndarray, threshold: int):
    """(i, others): for each text of a pair of blocks those that share a band, are in another part now, and come near it in size and signature."""
    value, holder = bands.ravel(), np.repeat(np.arange(len(side)), bands.shape[1])
    order = np.argsort(value, kind="stable")
    value, holder = value[order], holder[order]
    lo, hi = np.searchsorted(value, bands, "left"), np.searchsorted(value, bands, "right")
    two = bool(side.any())
    for i in range(int((side == 0).sum()) if two else len(side)):
        some = np.flatnonzero(hi[i] - lo[i] > 1)
        if not len(some):
            continue
        j = np.unique(np.concatenate([holder[lo[i, k] : hi[i, k]] for k in some]))
        j = j[(side[j] == 1) if two else (j > i)]
        j = j[(part[j] != part[i]) & (n[j] * 100 >= n[i] * threshold) & (n[i] * 100 >= n[j] * threshold)]
        j = j[(sign[j] == sign[i]).sum(axis=1) * 100 >= (threshold - 25) * sign.shape[1]]
        if len(j):
            yield i, j


def _likely(threshold: int):
    def run(table: pa.Table) -> pa.Table:
        """The texts of a pair of blocks that have a partner in another part by signature."""
        t, side, _, part, sign, bands = _ordered(table)
        kept = np.zeros(len(side), bool)
        for i, j in _partners(side, part, bands, sign, t.column("n_shingles").to_numpy(), threshold):
            kept[i] = True
            kept[j] = True
        return t.filter(pa.array(kept)).select(["pair", "side", "cls", "part", "bands", "signature"])

    return run


def _compared(threshold: int):
    def run(table: pa.Table) -> pa.Table:
        t, side, ids, part, sign, bands = _ordered(table)
        sets = [np.asarray(x) for x in (r.values.to_numpy(zero_copy_only=False).view(U) for r in t.column("items").chunk(0))]
        return _join_links(ids, part.copy(), side, bands, sign, sets, threshold)

    return run


def _join_links(ids: np.ndarray, part: np.ndarray, side: np.ndarray, bands: np.ndarray, sign: np.ndarray, sets: list[np.ndarray], threshold: int) -> pa.Table:
    """Links between texts that share a band and are in different parts, which merge as links are found."""
    n = np.array([len(s) for s in sets])
    flat, at = np.concatenate(sets), np.concatenate([[0], np.cumsum(n)])
    found: list[tuple[int, int]] = []
    for i, j in _partners(side, part, bands, sign, n, threshold):
        each = n[j]
        begin = np.cumsum(each) - each
        items = flat[np.repeat(at[j] - begin, each) + np.arange(int(each.sum()))]
        mine = sets[i]
        common = np.add.reduceat((mine[np.minimum(np.searchsorted(mine, items), len(mine) - 1)] == items).astype(np.int64), begin)
        for k in j[common * 100 >= (n[i] + each - common) * threshold]:
            if part[k] != part[i]:
                found.append((int(ids[i]), int(ids[k])))
                part[part == part[k]] = part[i]
    return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})


def op8_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Exact all-pairs similarity through the shingle index, then reachability, in DuckDB.
OP8_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws
  from documents
), s as (
  select distinct doc_id, unnest(case when len(ws) >= 5 then list_transform(range(1, len(ws) - 3), lambda i: array_to_string(list_slice(ws, i, i + 4), ' '))
                                      when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as sh
  from w
), n as (select doc_id, count(*) as n from s group by 1
), sets as (select doc_id, hash(list_sort(list(sh))) as h, count(*) as n from s group by 1
), rep as (select min(doc_id) as cls, h, n from sets group by h, n
), m as (select s.sh, s.doc_id from s join rep on s.doc_id = rep.cls
), link as (
  select a.doc_id as x, b.doc_id as y from m a join m b on a.sh = b.sh and a.doc_id < b.doc_id
  join n na on na.doc_id = a.doc_id join n nb on nb.doc_id = b.doc_id
  group by a.doc_id, b.doc_id, na.n, nb.n having 100 * count(*) >= 75 * (na.n + nb.n - count(*))
), e as (select x, y from link union select y, x from link
), reach as (select cls as node, cls as root from rep union select e.y, r.root from reach r join e on e.x = r.node
), comp as (select node, min(root) as c from reach group by 1)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(comp.c, d.doc_id) as component_id, coalesce(comp.c, d.doc_id) = d.doc_id as kept
from documents d left join n on n.doc_id = d.doc_id left join sets on sets.doc_id = d.doc_id
left join rep on rep.h = sets.h and rep.n = sets.n left join comp on comp.node = rep.cls
"""
