"""Heads and digests of files, read by the tasks."""

import hashlib
import json
import zipfile

import pytest

from wardstream.sources import files, readers, sinks


def test_ten_thousand_files_are_found_and_judged_by_the_tasks(spark, tmp_path):
    kinds = {"csv": "a,b,c\n1,2,3\n", "json": '{"a": 1}', "log": "some words\n", "TXT": '{"a": 1}\n{"a": 2}\n'}
    for i in range(10_000):
        ext = list(kinds)[i % 4]
        at = tmp_path / f"d{i % 10}"
        at.mkdir(exist_ok=True)
        (at / f"f{i}.{ext}").write_text(kinds[ext])
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "x.csv").write_text("a,b,c\n")
    (tmp_path / "d0" / "x.bin").write_bytes(b"no")
    spark.conf.set("spark.sql.files.openCostInBytes", "64k")
    try:
        found = readers.discover(spark, str(tmp_path))
        counts = {(r["format"], r["confidence"]): r["count"] for r in found.groupBy("format", "confidence").count().collect()}
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert counts == {("csv", 1.0): 2500, ("json", 1.0): 2500, ("text_log", 1.0): 2500, ("jsonl", 0.75): 2500}
    assert readers.discover(spark, str(tmp_path), max_depth=0).count() == 0


def test_large_files_are_hashed_in_chunks(spark, tmp_path, monkeypatch):
    big = b"0123456789abcdef" * (1 << 16)
    held = hashlib.sha256()
    with open(tmp_path / "part-big", "wb") as f:
        for _ in range(300):  # 300 MB
            f.write(big)
            held.update(big)
    (tmp_path / "part-small").write_bytes(b"e")
    (tmp_path / "other").write_bytes(b"x")
    assert sinks.file_hashes(spark, str(tmp_path)) == {"part-big": held.hexdigest(), "part-small": hashlib.sha256(b"e").hexdigest()}
    assert sinks.checksum_matches(spark, str(tmp_path / "part-big"), held.hexdigest().upper()) and not sinks.checksum_matches(spark, str(tmp_path / "other"), "00")
    (tmp_path / "part-big").unlink()
    monkeypatch.setattr(files, "SCHEMES", {})  # a store that only Spark opens
    assert sinks.file_hashes(spark, str(tmp_path)) == {"part-small": hashlib.sha256(b"e").hexdigest()}
    assert {r["head"]: r["size"] for r in files.heads(spark, str(tmp_path), 4).collect()} == {b"e": 1, b"x": 1}


@pytest.mark.parametrize("path,scheme", [("/a/b:c", "file"), ("file:/a", "file"), ("s3a://b/k", "s3a"), ("viewfs://x/y", "viewfs"), ("hdfs://n:8020/p", "hdfs")])
def test_schemes(path, scheme):
    assert files.scheme_of(path) == scheme


XMLNS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def workbook(path, sheets, shared=()):
    """A workbook of sheets, each a list of rows of cells' XML."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        names = "".join(f'<sheet name="s{i}" sheetId="{i}" r:id="r{i}"/>' for i in range(len(sheets)))
        z.writestr("xl/workbook.xml", f"<workbook {XMLNS}><sheets>{names}</sheets></workbook>")
        rels = "".join(f'<Relationship Id="r{i}" Target="{"/xl/" if i else ""}worksheets/s{i}.xml"/>' for i in range(len(sheets)))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {XMLNS}>{''.join(f'<si>{x}</si>' for x in shared)}</sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {XMLNS}><numFmts><numFmt numFmtId="170" formatCode="dd/mm/yy &quot;d&quot;"/><numFmt numFmtId="171" formatCode="0.0 &quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>')
        for i, rows in enumerate(sheets):
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {XMLNS}><sheetData>{''.join(f'<row>{r}</row>' for r in rows)}</sheetData></worksheet>")


def test_workbooks(spark, tmp_path):
    first = [
        '<c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>when</t></is></c>', '<c r="A2"><v>1</v></c><c r="B2" t="b"><v>1</v></c><c r="C2" s="1"><v>45292.5</v></c>',
        '<c r="A3"/>', '<c r="A4" t="s"><v>1</v></c><c r="D4" s="3"><v>2.50</v></c>', '<c r="C5" s="2"><v>45293</v></c>',
    ]
    second = ['<c t="str"><v>n</v></c>', *[f"<c><v>{i}</v></c>" for i in range(2500)]]
    workbook(tmp_path / "b.xlsx", [first, [], second], ["<t>id</t>", "<r><t>a </t></r><r><t>é</t></r><rPh><t>no</t></rPh>"])
    workbook(tmp_path / "c.xlsx", [second[:2]])
    rows = readers.read_excel(spark, str(tmp_path))
    held = {(r.source_name, r.record_index): json.loads(r.raw) for r in rows.collect()}
    assert len(held) == rows.count() == 3 + 2500 + 1
    assert held["b.xlsx", 0] == {"id": 1, "col1": True, "when": "2024-01-01 12:00:00"}
    assert held["b.xlsx", 1] == {"id": "a é", "col1": None, "when": None, "col3": 2.5} and held["b.xlsx", 2]["when"] == "2024-01-02 00:00:00"
    assert [held["b.xlsx", 3 + i] for i in range(2500)] == [{"n": i} for i in range(2500)] and held["c.xlsx", 0] == {"n": 0}
    got = readers.ingest(spark, str(tmp_path)).groupBy("source_format").count().collect()
    assert [tuple(r) for r in got] == [("excel", 2504)]


def test_csv_files_are_split_unless_quotes_span_lines(spark, tmp_path):
    (tmp_path / "flat.csv").write_text("id,t,u\n" + "".join(f'{i},"a, ""{i}""",x\n' for i in range(4000)))
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "span.csv").write_text('id,t,v\n1,"two\nlines",\n2,b,c\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        flat = readers.read_csv(spark, str(tmp_path / "flat.csv"))
        assert flat.rdd.getNumPartitions() > 4
        assert {r.record_index: json.loads(r.raw) for r in flat.collect()} == {i: {"id": str(i), "t": f'a, "{i}"', "u": "x"} for i in range(4000)}
        both = readers.read_csv(spark, [str(tmp_path / "flat.csv"), str(tmp_path / "deep")]).filter("source_name = 'span.csv'")
        assert [json.loads(r.raw) for r in both.orderBy("record_index").collect()] == [{"id": "1", "t": "two\nlines"}, {"id": "2", "t": "b", "v": "c"}]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
