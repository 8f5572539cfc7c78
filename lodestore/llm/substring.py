"""Removal of passages that repeat anywhere in the corpus, by prefix-partitioned suffix trees."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestore.llm.text import GOLDEN, U, as_bytes, longs, mix, slices, windows, word_hashes
from lodestore.plans.staging import stage, unstage

#: Words of a window, and of the prefix by which suffixes are dealt out.
WINDOW, PREFIX = 35, 8
#: Suffixes of one subtree group (about 12 MB); a prefix with more is grown.
GROUP_SUFFIXES = 150_000
#: The table of removed ranges, and that of prefixes to be grown, are broadcast up to this many bytes (summed first); beyond it both sides are shuffled.
BROADCAST_BYTES = 16 << 20
#: Words of one edge of a subtree; 35 is seven edges.
EDGE = 5
_WORD = re.compile(rb"[^\x20\x09-\x0d]+")
_STEP = 0x9E6C63D0876A9A47  # odd, so that its powers can be divided by


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(max(n, 1), U(base))
    out[0] = U(1)
    return np.cumprod(out, dtype=U)


def runs_of(texts: list[bytes], window: int, prefix: int) -> tuple[np.ndarray, ...]:
    """(text, start, count, offset, key, content) of the runs of each text's suffixes that start a whole window.

    A window is dealt by the least-hashed of the prefixes inside it (the leftmost of equals), which equal windows
    share, at an equal offset. Consecutive windows with the same prefix are one run: `count` windows from word
    `start`, the prefix `offset` words after it. `key` is the prefix's hash, `content` one of the run's whole words.
    """
    h, at = word_hashes(texts)
    lens = np.diff(at)
    if not len(h) or lens.max() < window:
        return tuple(np.empty(0, np.int64) for _ in range(4)) + (np.empty(0, U), np.empty(0, U))
    g = windows(h, prefix)
    span = window - prefix + 1
    least = np.lib.stride_tricks.sliding_window_view(g, span).argmin(axis=1) + np.arange(len(g) - span + 1)
    text = np.repeat(np.arange(len(texts)), np.maximum(lens - window + 1, 0))
    start = np.arange(len(text)) - np.repeat(np.concatenate([[0], np.cumsum(np.maximum(lens - window + 1, 0))[:-1]]), np.maximum(lens - window + 1, 0)) + at[text]
    p = least[start]
    first = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (text[1:] != text[:-1])]))
    count = np.diff(np.append(first, len(p)))
    s, p, text = start[first], p[first], text[first]
    up, down = _powers(len(h), _STEP), _powers(len(h), pow(_STEP, -1, 2**64))
    total = np.concatenate([np.zeros(1, U), np.cumsum(mix(h) * up, dtype=U)])
    content = mix((total[s + count + window - 1] - total[s]) * down[s] ^ (count * 64 + (p - s)).astype(U) * U(GOLDEN))
    return text, s - at[text], count, p - s, g[p], content


def _runs(window: int, prefix: int):
    def run(batches):
        for part in slices(batches):
            text, start, count, offset, key, content = runs_of(part.column(1).to_pylist(), window, prefix)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(text)), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(offset.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(content.view(np.int64))],
                names=["doc", "start", "count", "offset", "key", "content"],
            )

    return run


def _payload(window: int):
    def run(batches):
        """The words of each asked-for run as hashes."""
        for part in slices(batches):
            texts, asked = part.column(1).to_pylist(), part.column(2).to_pylist()
            h, at = word_hashes(texts)
            rows, words = [], []
            for base, runs in zip(at.tolist(), asked, strict=False):
                for r in runs:
                    rows.append((r["key"], r["content"], r["offset"], r["count"], r["suffixes"]))
                    words.append(h[base + r["start"] : base + r["start"] + r["count"] + window - 1])
            c = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.int32()), pa.array(c[4], pa.int64()), longs(words)], names=["key", "content", "offset", "count", "suffixes", "words"])

    return run


#: A part of a run under a grown prefix: the run, the first of its windows, and the least and largest offset of the prefix's core in the part's windows.
_PARTS = "key0 long, content0 long, place int, low int, high int, key long, content long, offset int, count int, words array<long>"


def halved(row: dict, window: int):
    """The run's part cut in two by the offset of the core in its windows; each grows its prefix to all the words that windows of such offsets share.

    At offsets low to high those are window - (high - low) words. Equal windows have equal offsets, so they stay together.
    """
    middle = (row["low"] + row["high"]) // 2
    split = min(max(row["offset"] - middle, 0), row["count"])
    words = np.array(row["words"], np.int64).view(U)
    for low, high, a, b in ((middle + 1, row["high"], 0, split), (row["low"], middle, split, row["count"])):
        if a < b:
            own, offset = words[a : b + window - 1], row["offset"] - a
            grown = own[offset - low : offset - high + window]
            key = mix(windows(grown, len(grown)) ^ mix(np.full(1, low * 64 + high, U)))
            content = mix(windows(own, len(own)) ^ U(offset))
            yield row["key0"], row["content0"], row["place"] + a, low, high, *key.view(np.int64).tolist(), *content.view(np.int64).tolist(), offset, b - a, own


def _halved(window: int):
    def run(batches):
        for batch in batches:
            rows = [x for r in batch.to_pylist() for x in halved(r, window)]
            c = list(zip(*rows, strict=True)) or [[]] * 10
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([*(pa.array(x, t) for x, t in zip(c[:9], kinds, strict=True)), longs(list(c[9]))], names=[x.split()[0] for x in _PARTS.split(", ")])

    return run


def subtree(key: np.ndarray, offset: np.ndarray, count: np.ndarray, words: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """Which windows of each run share a deep node, as bits of a long.

    The suffixes of the group's runs are split top-down by edges of EDGE words; a node left with one suffix is a leaf
    and isn't followed. Suffixes that still share a node at depth `window` stand in a maximal repeat.
    """
    run = np.repeat(np.arange(len(key)), count)
    place = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
    node = mix(key[run].view(U) ^ mix((offset[run] - place).astype(U)))
    begin, depth = at[run] + place, 0
    while True:
        _, back, n = np.unique(node, return_inverse=True, return_counts=True)
        some = n[back] > 1
        run, place, begin, node = run[some], place[some], begin[some], node[some]
        if depth == window or not len(run):
            break
        step = min(EDGE, window - depth)
        label = windows(words, step)
        node = mix(node * U(GOLDEN) ^ label[begin + depth])
        depth += step
    bits = np.zeros(len(key), np.int64)
    np.bitwise_or.at(bits, run, np.int64(1) << place)
    return bits


def _grown(window: int):
    def run(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        lists = t.column("words").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        at = lists.offsets.to_numpy().astype(np.int64)
        words = lists.values.to_numpy(zero_copy_only=False).view(U)
        bits = subtree(*(t.column(c).to_numpy() for c in ("key", "offset", "count")), words, at[:-1], window)
        return pa.table({"key": t.column("key"), "content": t.column("content"), "bits": pa.array(bits)})

    return run


def _few(table: DataFrame, column: str = "gone") -> DataFrame:
    """The table, to be broadcast if its bytes and 16 more a row are within the bound."""
    size = table.agg(F.sum(F.octet_length(F.col(column).cast("string")) + 16)).first()[0] or 0
    return F.broadcast(table) if size <= BROADCAST_BYTES else table


def _trees(runs: DataFrame, window: int, group: int) -> DataFrame:
    """(key, content, bits) of runs that are distinct by key and content, by subtrees of whole prefixes."""
    groups = 1 + (runs.agg(F.sum("count")).first()[0] or 0) // group
    t = runs.select("key", "content", "offset", "count", "words", F.pmod(F.xxhash64("key"), F.lit(groups)).alias("group"))
    return t.groupBy("group").applyInArrow(_grown(window), "key long, content long, bits long")


def _found(body: DataFrame, window: int, prefix: int, group: int) -> DataFrame:
    """(key, content, bits): the windows of each run that stand elsewhere too, among runs of one prefix.

    Prefixes of at most `group` suffixes go to subtrees. The runs of larger ones are halved, and each part's prefix
    grown, until they fit; equal parts of different runs are repeats as they are. At the latest all parts of a prefix
    are equal when it is the whole window.
    """
    out = [stage(_trees(body.where(F.col("suffixes") <= group), window, group), "trees")]
    rows = body.where(F.col("suffixes") > group).select(F.col("key").alias("key0"), F.col("content").alias("content0"), F.lit(0).alias("place"), F.lit(0).alias("low"), F.lit(window - prefix).alias("high"), "key", "content", "offset", "count", "words")
    old = None
    while rows.limit(1).count():
        parts = stage(rows.mapInArrow(_halved(window), _PARTS), "parts")
        unstage(old)
        old = parts
        kinds = stage(parts.groupBy("key", "content", "count").agg(F.count("*").alias("n")), "kinds")
        by = stage(kinds.groupBy("key").agg(F.count("*").alias("m"), F.sum("count").alias("suffixes")), "prefixes")
        large = _few(by.where((F.col("m") > 1) & (F.col("suffixes") > group)).select("key"), "key")
        fit = parts.join(_few(by.where((F.col("m") > 1) & (F.col("suffixes") <= group)).select("key"), "key"), "key", "left_semi")
        tree = _trees(stage(fit.groupBy("key", "content").agg(*(F.first(c).alias(c) for c in ("offset", "count", "words"))), "fit"), window, group)
        equal = kinds.where("n > 1").select("key", "content", F.expr("shiftleft(1L, count) - 1").alias("bits"))
        told = stage(tree.union(equal).where("bits <> 0"), "told")
        bits = parts.select("key0", "content0", "place", "key", "content").join(told, ["key", "content"]).select(F.col("key0").alias("key"), F.col("content0").alias("content"), F.expr("shiftleft(bits, place)").alias("bits"))
        out.append(stage(bits.groupBy("key", "content").agg(F.bit_or("bits").alias("bits")), "found"))
        rows = parts.join(large, "key", "left_semi").select([x.split()[0] for x in _PARTS.split(", ")])
    unstage(old)
    union = out[0]
    for t in out[1:]:
        union = union.union(t)
    return union.groupBy("key", "content").agg(F.bit_or("bits").alias("bits")) if out[1:] else union


def _merged(window: int):
    def run(batches):
        """Each text's repeated windows as the word ranges that they cover: int32 pairs, apart and in order."""
        for b in batches:
            out = []
            for spans in b.column(1).to_pylist():
                begin = sorted(s["start"] + i for s in spans for i in range(s["count"]) if s["bits"] >> i & 1)
                x = np.array(begin, np.int64)
                cut = np.flatnonzero(np.diff(x) > window) + 1
                ends = np.append(x[cut - 1], x[-1]) + window
                out.append(np.stack([x[np.append(0, cut)], ends], axis=1).astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["doc", "gone"])

    return run


def repeats(docs: DataFrame, id_col: str, text_col: str, window: int = WINDOW, prefix: int = PREFIX, group: int = GROUP_SUFFIXES) -> DataFrame:
    """(doc, gone): for each text with repeated windows, the ranges of words that they cover, as int32 pairs.

    `doc` is a hash of id and text. Windows are compared as 64-bit word and path hashes. What is joined is staged on
    both sides, so that Spark can split a hot key's partition.
    """
    if not 1 <= prefix <= window <= prefix + 62:
        raise ValueError("a prefix must be within its window, and at most 62 words shorter")
    texts = docs.select(F.col(id_col).alias("doc_id"), as_bytes(text_col).alias("text")).select(F.xxhash64("doc_id", "text").alias("doc"), "text")
    runs = stage(texts.mapInArrow(_runs(window, prefix), "doc long, start int, count int, offset int, key long, content long"), "runs")
    often = stage(runs.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "often")
    live = stage(runs.join(often, "key", "left_semi"), "live")
    each = stage(live.groupBy("key", "content").agg(F.count("*").alias("n"), F.min(F.struct("doc", "start", "count", "offset")).alias("at")), "each")
    many = stage(each.groupBy("key").agg(F.count("*").alias("m"), F.sum("at.count").alias("suffixes")).where("m > 1"), "many")
    asked = each.join(many, "key").select("at.doc", F.struct("at.start", "at.count", "at.offset", "key", "content", "suffixes").alias("r"))
    asked = stage(asked.groupBy("doc").agg(F.collect_list("r").alias("runs")), "asked")
    body = stage(texts.join(asked, "doc").select("doc", "text", "runs").mapInArrow(_payload(window), "key long, content long, offset int, count int, suffixes long, words array<long>"), "payload")
    found = _found(body, window, prefix, group)
    told = each.where("n > 1").select("key", "content", F.expr("shiftleft(1L, at.count) - 1").alias("bits")).union(found.where("bits <> 0"))
    told = stage(told.groupBy("key", "content").agg(F.bit_or("bits").alias("bits")), "told")
    spans = live.join(told, ["key", "content"]).groupBy("doc").agg(F.collect_set(F.struct("start", "count", "bits")).alias("spans"))
    spans = stage(spans.mapInArrow(_merged(window), "doc long, gone binary"), "spans")
    for t in (runs, often, live, each, many, asked, body, told):
        unstage(t)
    return spans


def gone_words(n: int, gone: bytes) -> np.ndarray:
    """Which of a text's n words the ranges cover."""
    out = np.zeros(n, bool)
    for a, b in np.frombuffer(gone, "<i4").reshape(-1, 2).tolist():
        out[a:b] = True
    return out


def without(text: bytes, gone: np.ndarray) -> bytes:
    """The text without those words; a gap leaves the blanks before it, once."""
    parts, at, last = [], 0, False
    for m, g in zip(_WORD.finditer(text), gone.tolist(), strict=True):
        if g:
            if not last:
                parts.append(text[at : m.start()])
            at = m.end()
        elif last:
            at = m.start()
        last = g
    return b"".join([*parts, b"" if last else text[at:]]).strip(b" \t\n\x0b\x0c\r")


def _cut(batches):
    for part in slices(batches):
        n_words, n_removed, digest, left = [], [], [], []
        for text, ranges in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
            words = kept = text.split()
            if ranges:
                gone = gone_words(len(words), ranges)
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                text = without(text, gone)
            n_words.append(len(words))
            n_removed.append(len(words) - len(kept))
            digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            left.append(text)
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest), pa.array(left, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The table itself with the repeated words cut from its texts; documents that lose all their words go."""
    spans = repeats(docs, id_col, text_col, window).withColumnsRenamed({"doc": "__doc", "gone": "__gone"})

    @F.arrow_udf("string")
    def trim(texts: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for text, s in zip(texts.to_pylist(), found.to_pylist(), strict=True):
            out.append(without(text, gone_words(len(text.split()), s)))
        return pa.array(out, pa.binary()).cast(pa.string())

    t = docs.withColumn("__doc", F.xxhash64(F.col(id_col), as_bytes(text_col))).join(_few(spans, "__gone"), "__doc", "left")
    t = t.withColumn("__cut", F.when(F.col("__gone").isNotNull(), trim(as_bytes(text_col), F.coalesce("__gone", F.lit(b"")))))
    t = t.where("__cut is null or __cut <> ''").withColumn(text_col, F.coalesce("__cut", text_col))
    return t.select(*docs.columns)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, prefix: int = PREFIX, group: int = GROUP_SUFFIXES) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by a space), kept_text.

    A word goes if a window of `window` words that covers it starts anywhere else, in the same text or another. All
    windows are judged on the input. kept_text is the text itself where nothing goes, else the text without the removed
    words. Null and empty texts, and those shorter than a window, keep all they have; rows with a null id count as
    texts of their own; repeated rows repeat each other. Other columns aren't read.
    """
    spans = repeats(docs, id_col, text_col, window, prefix, group)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), as_bytes(text_col).alias("text"), F.col(id_col).alias("own")).withColumn("doc", F.xxhash64("own", "text"))
    joined = texts.join(_few(spans), "doc", "left").select("doc_id", "text", "gone")
    return joined.mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def op10_substring(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept_text")


OP10_SQL = r"""
with w as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents
), win as (
  select doc_id, i, array_to_string(list_slice(ws, i, i + 34), ' ') as s from w, unnest(range(1, len(ws) - 33)) as u(i) where len(ws) >= 35
), twice as (select s from win group by s having count(*) > 1
), gone as (select distinct doc_id, unnest(range(i, i + 35)) as p from win semi join twice using (s)
), word as (select doc_id, unnest(ws) as x, generate_subscripts(ws, 1) as p from w
), kept as (select doc_id, string_agg(x, ' ' order by p) as t, count(*) as n from word anti join gone using (doc_id, p) group by 1)
select w.doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(kept.n, 0))::bigint as n_removed, sha256(coalesce(kept.t, '')) as kept_sha256
from w left join kept using (doc_id)
"""
