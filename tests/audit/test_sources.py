import io
import json
import zipfile

from vellum.operators import lock
from vellum.sources import readers, reports, tables
from vellum.streaming.audit import write_measured


def docx(*paragraphs):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f"<w:p><w:r>{p}</w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def test_read_sources(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"\xef\xbb\xbfone\r\ntwo\r")
    (tmp_path / "b.TXT").write_bytes(b"\xef\xbb\xbfbad \xff")
    (tmp_path / "c.docx").write_bytes(docx("<w:t>x</w:t><w:tab/><w:t>y</w:t><w:br/>", "", "<w:t>z</w:t>"))
    (tmp_path / "d.docx").write_bytes(b"no zip")
    rows = {r.path.rsplit("/", 1)[1]: r for r in readers.read_sources(spark, str(tmp_path)).collect()}
    assert rows["a.md"].text == "one\ntwo\n" and rows["a.md"].warnings == []
    assert rows["b.TXT"].suffix == ".txt" and rows["b.TXT"].text == "﻿bad �" and rows["b.TXT"].warnings == [readers.BAD_BYTES]
    assert rows["c.docx"].text == "x\ty\n\nz"[:3] + "\n\nz" and rows["c.docx"].source_kind == "docx"
    assert rows["d.docx"].text is None and "BadZipFile" in rows["d.docx"].error


def test_terms(spark, tmp_path):
    f = tmp_path / "t.txt"
    f.write_text(" alpha \n\n# note\nalpha\nｂeta\n", "utf-8")
    assert [r.term for r in readers.read_terms(spark, str(f)).collect()] == ["alpha", "# note", "beta"]
    assert [r.term for r in readers.read_plain_terms(spark, str(f)).collect()] == ["alpha", "alpha", "ｂeta"]


def test_links(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/x.md").write_text("[a](../y.md) [b](no.md#z) [c](../../out.md) [d](/abs.md) [e](#f) [g](https://h) [i]\n\n[i]: <../sub>\n")
    (tmp_path / "y.md").write_text("fine")
    (tmp_path / "z.bin").write_bytes(b"\xff\xfe")
    tree = readers.read_tree(spark, str(tmp_path))
    assert {r.path.rsplit("/", 1)[1]: r.text is None for r in tree.collect()} == {"x.md": False, "y.md": False, "z.bin": True}
    issues = [(r.code, r.message) for r in readers.link_issues(tree, str(tmp_path)).collect()]
    assert sorted(issues) == [("absolute_link", "/abs.md"), ("escaping_link", "../../out.md"), ("missing_link", "no.md#z")]


def test_reports(spark):
    df = spark.createDataFrame([(1, "5 mg 5 mg", "6 mg é")], "doc_id long, before string, after string")
    found = reports.lock_reports(lock.lock_category(df, lock.HIGH), lock.lock_status(df))
    report = json.loads(found.first().report)
    assert list(report)[:2] == ["status", "summary"] and report["status"] == "fail"
    assert report["categories"]["numbers"] == {"before_count": 2, "after_count": 1, "removed": ["5 mg", "5 mg"], "added": ["6 mg"]}
    assert reports.pretty({"b": "é", "a": 1}) == '{\n  "b": "é",\n  "a": 1\n}'
    assert reports.markdown_table(["a|b"], [("<x>\ny",)]) == "| a\\|b |\n|---|\n| &lt;x&gt;<br>y |\n"
    assert reports.python_round(2.675, 2) == 2.67
    assert reports.describe_report(0, 0, 0, None, None, None, "")["mean"] is None
    assert reports.describe_report(2, 6, 20, 2, 4, 6, "x")["cv"] == 0.333


def test_stream(spark, tmp_path, sf_dir):
    source = tmp_path / "in"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs.where("doc_id < 50").write.parquet(str(source))
    stream = lambda: spark.readStream.schema(docs.schema).parquet(str(source))
    write_measured(stream(), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    docs.where("doc_id between 50 and 99").write.mode("append").parquet(str(source))
    write_measured(stream(), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == out.select("doc_id").distinct().count() == docs.where("doc_id < 100").count()


def test_strict_input_and_pruning(spark, tmp_path, monkeypatch):
    (tmp_path / "keep").mkdir()
    (tmp_path / "gone" / "deep").mkdir(parents=True)
    (tmp_path / "keep" / "a.txt").write_bytes(b"\xef\xbb\xbfone\r\ntwo")
    (tmp_path / "gone" / "deep" / "b.txt").write_bytes(b"bad \xff")
    monkeypatch.setenv("HOME", str(tmp_path))
    good = readers.read_sources(spark, "~/keep/a.txt", strict=True).first()
    assert (good.text, good.error) == ("one\ntwo", None)
    bad = str(tmp_path / "gone" / "deep" / "b.txt")
    assert readers.read_sources(spark, bad, strict=True).first().error.startswith("UnicodeDecodeError")
    assert readers.read_sources(spark, bad).first().text == "bad \ufffd"
    assert readers.read_input(spark, b"x\xff").first().warnings and readers.read_input(spark, b"x\xff", strict=True).first().text is None
    assert [r.path.rsplit("/", 1)[1] for r in readers.read_tree(spark, str(tmp_path), ("gone",)).collect()] == ["a.txt"]


def test_small_tables_are_dealt_out(spark, sf_dir):
    path, split = f"{sf_dir}/documents.parquet", "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(split)
    try:
        assert tables.read_table(spark, path, "doc_id", "text").rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
        spark.conf.set(split, "1k")
        assert "RoundRobin" not in tables.read_table(spark, path)._jdf.queryExecution().toString()
    finally:
        spark.conf.set(split, before)
