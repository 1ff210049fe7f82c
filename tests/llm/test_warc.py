import base64
import gzip
import hashlib
import random

import pytest

from tagtide.llm import warc


def digest(t):
    return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()


ROWS = [(1, "http://a/", "<p>é</p>"), (2, "http://b/", "<p>é</p>"), (9, "http://c/", "<p>é</p>"), (3, None, None), (4, "u", ""), (5, "http://d/", "x\r\n\r\nWARC/1.1\r\nno record\r\n\r\n"), (6, "a\r\nb: c", "tail\r\n\r\n"), (7, "u", "same"), (7, "u", "same"), (None, "n", "alone"), (None, "n", "<p>é</p>"), (8, "big", "z" * 3_000_000)]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(*r, "x") for r in ROWS], "page_id long, url string, html string, payload string")


def test_revisits(pages):
    got = sorted(map(tuple, warc.deduplicated(pages).collect()), key=repr)
    want = []
    for i, _, t in ROWS:
        n, d = len((t or "").encode()), digest(t)
        top = max((x[0] for x in ROWS if (x[2] or "") == (t or "") and x[0] is not None), default=None)
        want.append((i, n, d, "response" if i == top else "revisit", None if i == top else top))
    first = want.index((7, 4, digest("same"), "response", None))
    want[first] = (7, 4, digest("same"), "revisit", 7)
    assert got == sorted(want, key=repr)


def test_archives_round_trip(spark, pages, tmp_path):
    folder = str(tmp_path / "w")
    warc.write_archives(warc.records(pages), folder, file_bytes=200)
    rows = warc.read_archives(spark, folder).collect()
    assert sorted(r["payload"] for r in rows if r["record_type"] == "response") == sorted({(t or "") for _, _, t in ROWS})
    assert all(r["payload"] == "" for r in rows if r["record_type"] == "revisit")
    assert all(digest(r["payload"]) == r["payload_digest"] for r in rows if r["record_type"] == "response")
    assert len(list((tmp_path / "w").glob("part-*"))) > 1


def test_archives_are_standard_gzip(spark, tmp_path):
    """Every file opens with plain gzip, one member per record; records of 16 MB or more included."""
    rng = random.Random(1)
    long = "".join(rng.choices("abcdefgh", k=1 << 10)) * (17 << 10)
    rows = [(i, "u", f"text {i}") for i in range(20)] + [(20, "u", long)]
    folder = tmp_path / "w"
    warc.write_archives(warc.records(spark.createDataFrame(rows, "page_id long, url string, html string")), str(folder))
    files = [f.read_bytes() for f in folder.glob("part-*")]
    assert sum(sum(1 for _ in warc.parse(gzip.decompress(f))) for f in files if f) == 21
    assert all(len(list(warc.parse(m))) <= 1 for f in files for m in warc.members(f))
    assert sorted(r["payload_length"] for r in warc.read_archives(spark, str(folder), payloads=False).collect())[-1] == len(long)


def test_foreign_archives(spark, tmp_path):
    """Archives that this module did not write: several members, several records in one, padding, unknown headers."""
    record = lambda i: f"WARC/1.0\r\nWARC-Type: response\r\nX-Other: a:b\r\nContent-Length: {len(str(i))}\r\n\r\n{i}\r\n\r\n".encode()
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(record(1)) + gzip.compress(record(22) + record(333)) + b"\0" * 512)
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(record(i)) for i in range(1000, 1100)))
    got = warc.read_archives(spark, str(tmp_path)).collect()
    assert sorted(int(r["payload"]) for r in got) == [1, 22, 333, *range(1000, 1100)]
    assert {r["payload_digest"] for r in got} == {None} and {r["record_type"] for r in got} == {"response"}
    with pytest.raises(ValueError):
        list(warc.members(gzip.compress(record(1))[:-6]))


def test_empty_table(pages):
    assert warc.deduplicated(pages.limit(0)).collect() == []


def test_broken_archives_are_told():
    with pytest.raises(ValueError):
        list(warc.parse(b"no archive\r\n\r\n"))


def test_reading_does_not_copy_the_rest_of_the_file(monkeypatch):
    """The bytes handed to zlib grow with the file, not with the file times its members."""
    rng = random.Random(2)
    parts = [bytes(rng.randrange(256) for _ in range(rng.choice((10, 500, 9000)))) for _ in range(300)]
    data = b"".join(map(gzip.compress, parts))
    fed, real = [], warc.zlib.decompressobj

    class Counted:
        def __init__(self, bits):
            self.it = real(bits)

        def decompress(self, piece):
            fed.append(len(piece))
            return self.it.decompress(piece)

        def __getattr__(self, name):
            return getattr(self.it, name)

    monkeypatch.setattr(warc.zlib, "decompressobj", Counted)
    assert list(warc.members(data)) == parts
    assert sum(fed) < 3 * len(data)
