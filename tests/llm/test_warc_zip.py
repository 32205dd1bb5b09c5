import hashlib
import io
import zipfile

import pytest

from parley.llm import warc_zip as op

KINDS = "page_id long, url string, html string, payload string, record_type string, n long"


def want(rows):
    lead = {}
    for i, _, h, *_ in rows:
        h = h or ""
        if i is not None and len(h.encode()) >= 100:
            lead[h] = min(lead.get(h, i), i)
    out = []
    for i, _, h, *_ in rows:
        h = h or ""
        again = h in lead and i != lead[h]
        out.append((i, len(h.encode()), hashlib.sha256(h.encode()).hexdigest(), "revisit" if again else "response", lead[h] if again else None))
    return out


@pytest.mark.parametrize("zip64", [False, True])
def test_round_trip(spark, zip64):
    big = "é" * 60
    rows = [(5, "http://a/", big, None, None, None), (2, None, big, "x", "y", 1), (9, "http://b/\r\nX: y", big, None, None, None), (1, "u", "small", None, None, None), (3, "u", "small", None, None, None), (4, "u", None, None, None, None), (6, "u", "", None, None, None), (None, "u", big, None, None, None), (7, "u", "z" * 200_000, None, None, None), (2, None, big, "x", "y", 1), (8, "u", "a\r\n\r\nb" * 40, None, None, None)]
    got = op.round_trip(spark.createDataFrame(rows, KINDS).repartition(3), zip64=zip64, member_bytes=300).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(want(rows), key=key)


def test_empty_table(spark):
    assert op.round_trip(spark.createDataFrame([], KINDS)).count() == 0


def test_members_are_located_in_foreign_archives():
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr(zipfile.ZipInfo("archive/a.warc"), b"abc")
        z.writestr("packed.txt", b"x" * 500, compress_type=zipfile.ZIP_DEFLATED)
        z.comment = b"a comment with PK inside"
        with z.open(zipfile.ZipInfo("wide"), "w", force_zip64=True) as f:
            f.write(b"12345")
    found = {m.name: m for m in op.stored_members(data, len(data.getvalue()))}
    assert set(found) == {"archive/a.warc", "wide"}
    for name, content in (("archive/a.warc", b"abc"), ("wide", b"12345")):
        m = found[name]
        assert data.getvalue()[m.start : m.start + m.size] == content


def test_zip64_directory_of_many_members():
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for i in range(66_000):
            z.writestr(zipfile.ZipInfo(f"m{i}"), b"")
    assert len(op.stored_members(data, len(data.getvalue()))) == 66_000


def test_a_changed_payload_is_an_error():
    record = op.build_record(1, "u", b"payload", 7, hashlib.sha256(b"payload").hexdigest(), "response", None)
    assert op.parse_record(record)[0:2] == (1, 7)
    with pytest.raises(ValueError, match="digest"):
        op.parse_record(record.replace(b"payload\r\n\r\n", b"PAYLOAD\r\n\r\n"))
