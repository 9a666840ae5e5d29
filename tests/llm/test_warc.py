"""Archives: round trip, revisits, dictionaries, odd input."""

import hashlib

import pytest

from maskwright.llm import warc as W


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def plain(rows):
    groups = {}
    for page, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 1000:
            groups.setdefault(data, []).append(page)
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        ids = [p for p in groups.get(data, ()) if p is not None]
        to = max(ids) if len(groups.get(data, ())) > 1 and ids and page != max(ids) else None
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


ROWS = [(k, f"http://h{k % 5}.example/é {k}\r\nX: y", f"<p>page {k % 40} ü</p>" * (20 + k % 7)) for k in range(150)]
ROWS += [(1000, "u", "z" * 1000), (1001, "u", "z" * 1000), (None, None, "z" * 1000), (1002, None, "z" * 999), (1003, "", "z" * 999),
         (1004, "u", None), (1005, "u", ""), (None, "u", "q" * 2000), (None, "u", "q" * 2000), (1006, "u", "€" * 400), (1007, "u", "€" * 400),
         (1008, "u", "w" * 3_000_000), (1009, "u", "\r\n\r\n" * 400), (1007, "u", "€" * 400)]


@pytest.mark.parametrize("limits", [W.Archive(), W.Archive(payload_bytes=20_000, sample_bytes=4_000, dictionary_bytes=1024)])
def test_what_was_written_is_read_back(spark, limits):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string").repartition(3)
    manifest = W.write_archives(df, limits=limits)
    got = W.read_archives(manifest)
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert rows_of(got.select(*columns)) == plain(ROWS)
    assert got.where("not sound").count() == 0
    payloads = {(r.page_id, bytes(r.payload)) for r in got.where("record_type = 'response'").collect()}
    assert payloads == {(p, (h or "").encode()) for p, _, h in ROWS if (p, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), "response", None) in plain(ROWS)}
    assert manifest.agg({"records": "sum"}).first()[0] == len(ROWS)


def test_the_dictionary_leads_and_records_stand_alone(tmp_path):
    writer = W.Writer(f"file://{tmp_path}", W.Archive())
    made = [W.record(k, f"http://x/{k}", (f"<div class=item>Number {k}</div>" * 9).encode(), "00" * 20, None, "2024-01-01T00:00:00Z") for k in range(200)]
    for data in made:
        writer.add(data)
    writer.close()
    path, records, size = writer.done[0]
    with open(path[7:], "rb") as f:
        head = f.read(4)
    assert head == W.DICTIONARY_MARK and records == 200 and size < sum(map(len, made)) // 3
    assert list(W.read_archive(path)) == made
    assert list(W.read_archive(path, chunk=7)) == made


def test_a_cut_archive_is_an_error(tmp_path):
    writer = W.Writer(f"file://{tmp_path}", W.Archive())
    writer.add(W.record(1, "u", b"x" * 100_000, "00" * 20, None, "d"))
    writer.close()
    path = writer.done[0][0]
    data = open(path[7:], "rb").read()
    open(path[7:], "wb").write(data[:-3])
    with pytest.raises(Exception):
        list(W.read_archive(path))


def test_empty_tables_and_clashing_columns(spark):
    df = spark.createDataFrame(ROWS[:3], "page_id long, url string, html string")
    for name in ("page", "digest", "last", "again", "same", "refers_to"):
        df = df.withColumn(name, df.url)
    assert W.read_archives(W.write_archives(df)).count() == 3
    assert W.read_archives(W.write_archives(df.limit(0))).count() == 0
