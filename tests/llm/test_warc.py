import gzip
import hashlib

from barline.llm.common import shared_path
from barline.llm.warc import _place, archive_pages, read_records, read_warc, write_warc

LONG = "<p>" + "x" * 1200


def frame(spark, rows):
    return spark.createDataFrame([(*r, "n") for r in rows], "page_id bigint, url string, html string, digest string")


def test_revisits_and_round_trip(spark):
    rows = [(1, "u1", LONG), (2, None, LONG), (9, "u9", LONG), (3, "a", "short"), (4, "b", "short"), (5, "é", None), (6, "", ""), (7, "u", "é" * 600), (8, "u", "é" * 499), (10, "u", "é" * 499), (None, "u", LONG), (9, "u9", LONG)]
    got = sorted((tuple(r) for r in archive_pages(frame(spark, rows), file_bytes=600).collect()), key=str)
    expected = []
    for page, _, html in rows:
        raw = (html or "").encode()
        refers = 9 if html == LONG and page != 9 else None
        expected.append((page, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if refers else "response", refers))
    assert got == sorted(expected, key=str)


def test_files_are_the_same_each_time_and_payloads_come_back(spark):
    df = frame(spark, [(i, f"http://x/{i}", f"<p>{i}" * (300 if i % 7 else 1)) for i in range(60)])
    seen = []
    for n in (3, 5):
        folder = shared_path(spark, "warc-test")
        manifests = write_warc(df.repartition(n), folder, file_bytes=400)
        fs, root = _place(folder)
        names = sorted(r["name"] for r in manifests.collect())
        files = sorted(x.base_name for x in fs.get_file_info(__import__("pyarrow").fs.FileSelector(root)))
        assert files == sorted([*names, *(f"{x}.manifest" for x in names)]) and len(names) > 8
        seen.append({x: fs.open_input_stream(f"{root}/{x}", compression=None).read() for x in files})
        back = {r.page_id: r.payload.decode() for r in read_warc(spark, folder, manifests).collect()}
        assert back == {r.page_id: r.html for r in df.collect()}
    assert seen[0] == seen[1]
    whole = next(v for k, v in seen[0].items() if k.endswith(".gz"))
    assert gzip.decompress(whole).startswith(b"WARC/1.1\r\n") and len(list(read_records(whole))) >= 1


def test_no_pages(spark):
    assert archive_pages(frame(spark, [])).collect() == []


def test_null_ids_and_repeats_agree_with_the_sql(spark):
    import duckdb

    from barline.llm import oracles

    long, other = "x" * 1500, "y" * 1500
    rows = [(1, "u", long), (None, "u", long), (2, None, long), (2, "u", long), (None, "u", other), (None, "v", other), (3, "u", "short"), (None, "u", "short"), (4, "u", None), (5, "u", None)]
    got = archive_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    want = con.execute(oracles.WARC).fetchall()
    names = [x[0] for x in con.description]
    assert sorted([tuple(r[n] for n in names) for r in got], key=str) == sorted(want, key=str)
