"""Raw folders: partitions by bytes, DOCX and PDF by the standard library, broken files."""

import io
import time
import zipfile

from pyspark.sql import functions as F

from tessera.sources import raw


def test_docx():
    made = raw.docx_document(["One & two", "", "three"], [["a", "b"], ["1", "2 < 3"]])
    assert raw.docx_text(made) == "One & two\n\nthree\n| a | b |\n|---|---|\n| 1 | 2 < 3 |"
    w = raw._W[1:-1]
    xml = f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t><w:br/><w:t>c</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p/></w:tc></w:tr></w:tbl></w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("word/document.xml", xml)
    assert raw.docx_text(out.getvalue()) == "a\tb\nc\n|  |  |\n|---|---|"


def test_pdf():
    for deflate in (True, False):
        made = raw.pdf_document([["First (line)", "back\\slash"], [], ["Zweite Straße"]], deflate)
        assert raw.pdf_text(made) == "First (line)\nback\\slash\n\n\n\nZweite Straße"
    shown = raw._shown(b"BT [(Hel) -20 (lo) -300 (world)] TJ T* <48 69> Tj (a (nested) b\\051\\\n c) ' ET")
    assert shown == "Hello world\nHi\na (nested) b) c"
    assert raw.pdf_text(b"%PDF no objects") == ""


def test_long_streams_take_seconds():
    begin = time.time()
    raw._shown(b"(" * 200_000)
    assert raw._shown(b"(x) Tj " * 200_000) == "x" * 200_000
    raw.pdf_text(b"1 0 obj " * 100_000)
    assert time.time() - begin < 30


def test_folder(spark, tmp_path):
    rows = [(f"d{i % 3}/f{i}.txt", f"text {i}".encode()) for i in range(40)]
    rows += [("a.docx", raw.docx_document(["doc"])), ("b.PDF", raw.pdf_document([["page"]])), ("broken.docx", b"PK none"), ("blank.md", b" \n"), (".hidden", b"x"), ("d/.h/x", b"x"), ("bad.txt", b"ab\xff\xfec")]
    assert raw.write_files(spark.createDataFrame(rows, "name string, content binary").repartition(3), f"file://{tmp_path}/in") == 47
    df = raw.read_folder(spark, f"file://{tmp_path}/in", partition_bytes=3 * raw.OPEN_BYTES)
    got = {r["doc_id"]: r["text"] for r in df.collect()}
    assert got == {**{f"d{i % 3}/f{i}.txt": f"text {i}" for i in range(40)}, "a.docx": "doc", "b.PDF": "page", "bad.txt": "abc"}
    assert 10 <= df.rdd.getNumPartitions() <= 25
    assert raw.read_folder(spark, f"file://{tmp_path}/in").rdd.getNumPartitions() == 1


def test_customers_of_one_partition_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    from tessera.plans import registry

    kept = raw.write_files
    seen = []
    monkeypatch.setattr(raw, "write_files", lambda rows, folder: seen.append(rows.groupBy(F.spark_partition_id()).count().count()) or kept(rows, folder))
    spark.range(1, 301).selectExpr("id as c_custkey", "id % 5 as c_nationkey", "'x' as c_name", "'y' as c_mktsegment").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    assert registry.queries()["rich_documents"](spark, str(tmp_path)).count() == 300
    assert seen[0] >= 4
