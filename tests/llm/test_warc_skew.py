"""The audit's records where ids are null, repeated or have equal pages."""

import hashlib

import pytest

from lodestore.llm import warc


def plain(rows):
    made = []
    for i, u, h in rows:
        body = (h or "").encode()
        head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{'' if i is None else i}>\r\nWARC-Target-URI: {u or ''}\r\nContent-Length: {len(body)}\r\n\r\n".encode()
        made.append((-1 if i is None else i // warc.ARCHIVE_IDS, i, hashlib.sha256(head + body + b"\r\n\r\n").hexdigest(), len(head) + len(body) + 4))
    out, archive = [], None
    for a, i, d, n in sorted(made, key=lambda r: (r[0], r[1] or 0, r[2])):
        if a != archive:
            archive, place, at = a, 0, 0
        out.append((i, a, place, at, at + n, d))
        place, at = place + 1, at + n
    return sorted(out, key=str)


@pytest.mark.parametrize("copies", [warc.COPIES, 7])
def test_null_repeated_and_equal_pages_have_their_ranges(spark, monkeypatch, copies):
    monkeypatch.setattr(warc, "COPIES", copies)
    rows = [(None, "u", f"p{k % 40}") for k in range(90)] + [(None, None, None)] * 50 + [(5, "u", f"é{k}") for k in range(60)] + [(5, "u", "same")] * 30 + [(k, "u", "x" * (k % 9)) for k in range(990, 1010)] + [(7, "u", "y" * 2_000_000), (8, "", "")]
    table = spark.createDataFrame([(*r, "z", 1) for r in rows], "page_id long, url string, html string, digest string, n int").repartition(4)
    got = sorted((tuple(r) for r in warc.leaves(table).collect()), key=str)
    assert got == plain(rows)
    assert warc.audit(warc.leaves(table), warc.leaves(table.repartition(2))).count() == 0
    other = spark.createDataFrame([(*r, "z", 1) for r in rows[:89] + [(None, "u", "changed")] + rows[90:]], table.schema)
    assert {r.archive for r in warc.audit(warc.leaves(table), warc.leaves(other)).collect()} == {-1}
