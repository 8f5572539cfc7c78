"""Fill-in-the-middle documents by a piece table: descriptors over an immutable text and a buffer of sentinels."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestore.llm.text import as_bytes, slices

#: The sentinels that stand before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINELS = PREFIX + SUFFIX + MIDDLE
#: Of a hundred documents, so many are transformed, and of a hundred of those so many in the order suffix, prefix, middle.
RATE, SPM_RATE = 90, 20
#: Code points that are encoded at once when descriptors are read.
CHUNK = 1 << 16
TEXT, MARKS = 0, 1
#: What stands where in the output: a sentinel's place in its buffer, and the text part behind it.
ORDERS = {"psm": ((PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)), "spm": ((SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1))}


class Piece(NamedTuple):
    """So many code points of a buffer from a place on."""

    buffer: int
    start: int
    length: int


def cut(pieces: list[Piece], at: int) -> list[Piece]:
    """The same text with a border between descriptors after `at` code points, splitting the one that spans it."""
    out: list[Piece] = []
    for p in pieces:
        if 0 < at < p.length:
            out += [Piece(p.buffer, p.start, at), Piece(p.buffer, p.start + at, p.length - at)]
        else:
            out.append(p)
        at -= p.length
    return out


def thirds(length: int, first: int, second: int) -> list[list[Piece]]:
    """Prefix, middle and suffix of a text of so many code points, each as descriptors; a part without text has none."""
    pieces = cut(cut([Piece(TEXT, 0, length)], first), second)
    bounds = ((0, first), (first, second), (second, length))
    return [[p for p in pieces if p.length and a <= p.start and p.start + p.length <= b] for a, b in bounds]


def arranged(parts: list[list[Piece]], form: str) -> list[Piece]:
    """The parts behind their sentinels in the order of the form."""
    out: list[Piece] = []
    for mark, part in ORDERS[form]:
        out += [Piece(MARKS, SENTINELS.index(mark), len(mark)), *parts[part]]
    return out


def restored(output: str, form: str) -> list[Piece]:
    """Descriptors over an output that give its text again: cut at the sentinels, which the text doesn't hold, and permuted back."""
    if form == "plain":
        return [Piece(TEXT, 0, len(output))]
    order, at, found = ORDERS[form], 0, {}
    starts = []
    for mark, _ in order:
        at = output.index(mark, at) + len(mark)
        starts.append(at)
    ends = [s - len(m) for s, (m, _) in zip(starts[1:], order[1:], strict=True)] + [len(output)]
    for (_, part), a, b in zip(order, starts, ends, strict=True):
        found[part] = Piece(TEXT, a, b - a)
    return [found[k] for k in sorted(found)]


def streamed(pieces: list[Piece], buffers: tuple[str, str]) -> Iterator[str]:
    """The text of the descriptors, in chunks."""
    for p in pieces:
        for at in range(p.start, p.start + p.length, CHUNK):
            yield buffers[p.buffer][at : min(at + CHUNK, p.start + p.length)]


def digest(pieces: list[Piece], buffers: tuple[str, str]) -> str:
    """Hex SHA-256 of the UTF-8 bytes of the descriptors' text, which is never put together."""
    h = hashlib.sha256()
    for chunk in streamed(pieces, buffers):
        h.update(chunk.encode("utf-8", "surrogateescape"))
    return h.hexdigest()


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers from the hash of seed and id; a null id is hashed as no digits."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[k : k + 8], 16) for k in range(0, 32, 8)]


def planned(doc_id: int | None, text: str, seed: int, rate: int, spm_rate: int) -> tuple[str, int, int, list[Piece]]:
    """Form, lengths of prefix and middle, and the descriptors of one document's output."""
    h1, h2, h3, h4 = draws(doc_id, seed)
    n = len(text)
    if not n or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rate:
        return "plain", 0, 0, [Piece(TEXT, 0, n)]
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    form = "spm" if h4 % 100 < spm_rate else "psm"
    return form, first, second - first, arranged(thirds(n, first, second), form)


_SHAPE = "doc_id long, n long, form string, prefix_chars long, middle_chars long"


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), as_bytes(text_col).alias("text"))


def _mapped(docs: DataFrame, row, extra: list[tuple[str, pa.DataType]], spark_extra: str, id_col: str, text_col: str) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), *extra])

    def run(batches):
        for part in slices(batches):
            texts = (t.decode("utf-8", "surrogateescape") for t in part.column(1).to_pylist())
            yield _table([row(d, t) for d, t in zip(part.column(0).to_pylist(), texts, strict=True)], schema)

    return _documents(docs, id_col, text_col).mapInArrow(run, f"{_SHAPE}, {spark_extra}")


def transform(docs: DataFrame, seed: int = 1, rate: int = RATE, spm_rate: int = SPM_RATE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n, form, prefix_chars, middle_chars and the output, as UTF-8 bytes.

    Documents are cut and arranged where they are read: no shuffle, and a task holds one slice of texts. A null or empty
    text is plain and comes out empty; so does a text that holds a sentinel come out as it is. Rows with a null or
    repeated id are documents of their own, drawn by their id as it stands (a null one by no digits). Other columns
    aren't read. A table without rows gives none.
    """

    def row(doc, text):
        form, prefix, middle, pieces = planned(doc, text, seed, rate, spm_rate)
        out = b"".join(c.encode("utf-8", "surrogateescape") for c in streamed(pieces, (text, SENTINELS)))
        plain = form == "plain"
        return doc, len(text), form, None if plain else prefix, None if plain else middle, out

    return _mapped(docs, row, [("output", pa.binary())], "output binary", id_col, text_col)


def restore(outputs: DataFrame, form: str = "form", output: str = "output", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, text binary): the texts again, from each output and its form alone.

    A null output is the empty text, a null form plain. An output that lacks a sentinel of its form is an error.
    """

    def run(batches):
        for part in slices(batches):
            ids, texts, forms = (part.column(k).to_pylist() for k in range(3))
            back = []
            for t, f in zip(texts, forms, strict=True):
                t = t.decode("utf-8", "surrogateescape")
                back.append(b"".join(c.encode("utf-8", "surrogateescape") for c in streamed(restored(t, f), (t, SENTINELS))))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(back, pa.binary())], names=["doc_id", "text"])

    kind: Column = F.coalesce(F.col(form), F.lit("plain")).alias("form")
    return outputs.select(F.col(id_col).cast("long").alias("doc_id"), as_bytes(output).alias("text"), kind).mapInArrow(run, "doc_id long, text binary")


def digests(docs: DataFrame, seed: int = 1, rate: int = RATE, spm_rate: int = SPM_RATE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """transform() with hashes for texts: output_sha256 streams the descriptors; restored_sha256 reads the text rebuilt from output and form."""

    def row(doc, text):
        form, prefix, middle, pieces = planned(doc, text, seed, rate, spm_rate)
        out = "".join(streamed(pieces, (text, SENTINELS)))
        back = digest(restored(out, form), (out, SENTINELS))
        plain = form == "plain"
        return doc, len(text), form, None if plain else prefix, None if plain else middle, digest(pieces, (text, SENTINELS)), back

    return _mapped(docs, row, [("output_sha256", pa.string()), ("restored_sha256", pa.string())], "output_sha256 string, restored_sha256 string", id_col, text_col)


def op13_middle(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = """
with d as (
  select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n, sha256('1:' || doc_id) as h from documents
), g as (
  select *, ('0x' || substr(h, 1, 8))::ubigint as h1, ('0x' || substr(h, 9, 8))::ubigint as h2, ('0x' || substr(h, 17, 8))::ubigint as h3, ('0x' || substr(h, 25, 8))::ubigint as h4 from d
), c as (
  select doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1))::bigint as a, greatest(h1 % (n + 1), h2 % (n + 1))::bigint as b,
    case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form
  from g
), o as (
  select *, substr(t, 1, a) as p, substr(t, a + 1, b - a) as m, substr(t, b + 1) as s from c
)
select doc_id, n::bigint as n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(t) as restored_sha256
from o
"""
