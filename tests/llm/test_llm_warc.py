import gzip
import hashlib
import io
import os

import pytest

from tablewright.llm import warc

PAGES = "page_id long, url string, html string, n int, payload string, key int"


def pages():
    big = "<html>" + "é" * 900
    rows = [(i, f"http://x/{i}", f"<p>{i}</p>" * (i % 40)) for i in range(120)]
    rows += [(200 + i, f"http://y/{i}", big) for i in range(30)] + [(300, "u\r\nX-Evil: 1", "short"), (301, None, "short"), (302, "u", None), (303, "u", "")]
    rows += [(None, "n", "a page without a key"), (7, "http://x/7b", "another page 7"), (7, "http://x/7b", "another page 7"), (None, "n", big)]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], PAGES).repartition(4)


SETTINGS = warc.Settings(shard_rows=40, file_bytes=4000)


def test_archive_says_what_the_pages_said(spark, tmp_path):
    rows = pages()
    got = warc.archived(table(spark, rows), settings=SETTINGS, path=str(tmp_path / "a")).collect()
    assert len(got) == len(rows)
    seen = {}
    for r in got:
        seen.setdefault((r.page_id, r.payload_digest), []).append(r)
    for page, _, html in rows:
        data = (html or "").encode()
        r = seen[page, hashlib.sha1(data).hexdigest()].pop()
        assert r.payload_bytes == len(data)
        revisit = len(data) >= 1000 and page != 229
        assert (r.record_type, r.refers_to) == (("revisit", 229) if revisit else ("response", None))


def test_files_are_plain_warc(spark, tmp_path):
    rows = pages()
    path = str(tmp_path / "b")
    manifest = warc.write_archive(table(spark, rows), path, settings=SETTINGS).collect()
    assert len(manifest) > 3 and sum(m.n_records for m in manifest) == len(rows)
    text = {}
    for m in manifest:
        with open(os.path.join(path, m.file), "rb") as file:
            data = file.read()
        assert hashlib.sha256(data).hexdigest() == m.sha256 and len(data) == m.n_bytes
        # Each record is a member of its own, and a whole file is one gzip stream.
        whole = gzip.decompress(data)
        parts = [x for _, x in warc.members(io.BytesIO(data), 7)]
        assert b"".join(parts) == whole and len(parts) == m.n_records
        text[m.file] = whole
    assert all(b"X-Evil" not in x.split(b"\r\n\r\n")[0].split(b"\r\n") for x in text.values())
    assert not [f for f in os.listdir(path) if f.startswith(".part") and not f.endswith(".crc")]


def test_the_same_pages_give_the_same_archive(spark, tmp_path):
    rows = pages()
    a = warc.write_archive(table(spark, rows), str(tmp_path / "c"), settings=SETTINGS)
    b = warc.write_archive(table(spark, rows[::-1]).repartition(9), str(tmp_path / "d"), settings=SETTINGS)
    assert sorted(a.collect()) == sorted(b.collect())


def test_broken_archives_are_noticed():
    good = warc.record("response", "1:0", "u", b"hello", hashlib.sha1(b"hello").hexdigest(), None, "d")
    assert warc.parse(good)["payload"] == b"hello"
    with pytest.raises(ValueError, match="broken"):
        warc.parse(good.replace(b"hello", b"jello"))
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.members(io.BytesIO(gzip.compress(good)[:-9])))


def test_no_pages(spark, tmp_path):
    assert warc.archived(table(spark, []), path=str(tmp_path / "e")).count() == 0
