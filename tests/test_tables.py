"""Sheets, catalogue, guard, date ranges, charts."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from sheafline import catalog, guard
from sheafline.operators import present
from sheafline.sources import files, sheets

CSV = """Order ID,Order Date,Region,Product Code,Quantity,Unit Price,Claim Amount,Status
ORD-001,2025-07-04,West,0041290,2,10.50,100.10,Shipped
ORD-002,2025-08-11,East,0041291,1,20.00,250.00,Pending
ORD-003,2025-09-15,West,0041292,7,5.25,"1,015.13",Cancelled
ORD-004,2025-10-02,North,0041293,3,8.00,0.00,Shipped
ORD-005,2025-11-20,East,0041294,4,9.75,,Shipped
ORD-006,2025-12-30,West,0041295,5,1.00,10.00,Shipped
"""


def test_read_csv_types_and_roles(spark, tmp_path):
    (tmp_path / "orders.csv").write_text("Quarterly report\n\n" + CSV)
    df, p = sheets.read_csv(spark, str(tmp_path / "orders.csv"))
    roles = {c.name: (c.type, c.role) for c in p.columns}
    assert p.header_row == 2
    assert roles["order_id"] == ("TEXT", "id") and roles["order_date"] == ("TEXT", "date") and roles["product_code"] == ("TEXT", "id")
    assert roles["quantity"] == ("INTEGER", "number") and roles["unit_price"] == ("REAL", "number") and roles["status"] == ("TEXT", "category")
    rows = df.orderBy("_row").collect()
    assert len(rows) == 6 and rows[0]._row == 4 and rows[0].product_code == "0041290"
    assert df.agg(F.round(F.sum("claim_amount"), 2)).first()[0] == 1375.23
    assert rows[4].claim_amount is None


def test_cells_with_line_ends(spark, tmp_path):
    (tmp_path / "n.csv").write_text('City,Note\nOslo,"two\nlines"\n\nBern,"a ""b"""\n')
    df, _ = sheets.read_csv(spark, str(tmp_path / "n.csv"))
    assert [(r._row, r.city, r.note) for r in df.orderBy("_row").collect()] == [(2, "Oslo", "two\nlines"), (4, "Bern", 'a "b"')]


def test_prose_is_no_table(spark, tmp_path):
    (tmp_path / "p.csv").write_text("This is a letter.\nIt has no table in it.\n")
    with pytest.raises(ValueError):
        sheets.read_csv(spark, str(tmp_path / "p.csv"))


def test_identifiers_and_delimiters():
    assert sheets.identifiers(["A b", "A-b", "", "1st", "rowid"]) == ["a_b", "a_b_2", "col_3", "col_1st", "col_rowid"]
    assert sheets.sniff_delimiter("a;b;c\n1,5;2;3\n") == ";"
    assert sheets.sniff_delimiter("a\tb\n1\t2\n") == "\t"


def xlsx() -> bytes:
    m = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{m}" xmlns:r="{rel}"><sheets><sheet name="Sales" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{m}"><si><t>City</t></si><si><t>Total</t></si><si><t>Oslo</t></si></sst>')
        rows = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row>' + "".join(f'<row r="{i}"><c r="A{i}" t="s"><v>2</v></c><c r="B{i}"><v>{i}</v></c></row>' for i in (2, 3, 5))
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{m}"><sheetData>{rows}</sheetData></worksheet>')
    return b.getvalue()


def test_xlsx(spark, tmp_path):
    (tmp_path / "b.xlsx").write_bytes(xlsx())
    [(df, p)] = sheets.read_xlsx(spark, str(tmp_path / "b.xlsx"))
    assert [(r._row, r.city, r.total) for r in df.orderBy("_row").collect()] == [(2, "Oslo", 2), (3, "Oslo", 3), (5, "Oslo", 5)]


def test_union_of_equal_shapes_keeps_other_views(spark):
    c = catalog.Catalog(spark)
    for q in ("q1", "q2", "q3"):
        c.register(f"sales_{q}", spark.createDataFrame([(1, "x"), (2, None)], "amount long, city string"), f"{q}.csv")
    c.register("sales_q1_clean", c.frame("sales_q1"), kind="view")
    assert c.build_unions() == ["sales_q_all"]
    assert c.frame("sales_q_all").count() == 6 and "sales_q1_clean" in c.tables
    assert c.build_unions() == ["sales_q_all"]
    assert "over 3 tables" in c.render()


REFUSED = ["drop table x", "select 1; select 2", "insert into t values (1)", "with a as (select 1) insert into t select * from a", "", "pragma x", "create table t as select 1", "select * from (delete from t)", "explain select 1", "update t set a = 1"]
ALLOWED = ["select 1", "```sql\nselect 1\n```", "select 'drop table; x' as s", "with a as (select 1 as x) select x from a;", "select replace('a', 'a', 'b') as r -- drop", "select trim(' a ') as t"]


@pytest.mark.parametrize("q", REFUSED)
def test_guard_refuses(spark, q):
    with pytest.raises(guard.Refused):
        guard.validate(spark, q)


@pytest.mark.parametrize("q", ALLOWED)
def test_guard_allows(spark, q):
    assert guard.run_sql(spark, q).ok


def test_caps_and_timeout(spark):
    r = guard.run_sql(spark, "select id from range(10)", limit=3)
    assert len(r.rows) == 3 and r.truncated
    r = guard.run_sql(spark, "select count(*) from range(3000000) a join range(3000000) b on a.id * b.id % 7 = 3", timeout=2)
    assert not r.ok and guard.run_sql(spark, "select 1").ok


def test_date_range_is_inside_both_days(spark):
    df = spark.sql("select * from values (timestamp'2025-01-01 00:00:00', 1), (timestamp'2025-01-31 23:59:59', 2), (timestamp'2025-02-01 00:00:00', 3) t(d, v)")
    s = present.range_session(spark, {"t": (df, "d")}, "2025-01-01", "2025-01-31")
    assert s.sql("select sum(v) from t").first()[0] == 3
    with pytest.raises(ValueError):
        present.in_range(df, "d", "2025-1-1", None)


def test_charts():
    R = guard.Result
    assert present.infer_chart(R(["n"], [[5]])).kind == "stat"
    assert present.infer_chart(R(["d", "v"], [["2025-02-01", 2], ["2025-01-01", 1], [None, 9]])).labels == ["2025-01-01", "2025-02-01"]
    assert present.infer_chart(R(["c", "v"], [["a", 1], ["b", 3]])).labels == ["b", "a"]
    assert present.infer_chart(R(["c", "v"], [[f"a label that is long {i}", i] for i in range(20)])).kind == "hbar"
    assert len(present.infer_chart(R(["c", "v"], [[str(i) + "x", i] for i in range(40)])).labels) == 15
    assert present.infer_chart(R(["a", "b", "v"], [["x", "p", 1], ["x", "q", 2], ["y", "p", 3]])).series == {"p": [1, 3], "q": [2, 0]}
    assert present.infer_chart(R(["id", "v"], [[1, 2], [2, 3]]), {"id": "id"}).kind == "table"
    assert len(present.thin(1000)) <= 401 and present.thin(1000)[-1] == 999


def test_dashboards(spark):
    d = present.Dashboards(spark)
    d.create("b")
    d.add("b", present.Panel("p", "select 1 as n"))
    with pytest.raises(guard.Refused):
        d.add("b", present.Panel("q", "drop table x"))
    e = present.Dashboards(spark)
    e.load(d.dump())
    assert e.run("b")[0]["chart"].kind == "stat" and e.counts() == {"b": 1}


def test_extractors():
    assert files.extract(".html", b"<head><title>x</title></head><p>A<script>no</script> b</p><ul><li>c</li></ul>")[0][0] == "A b\n\nc"
    assert files.extract(".md", b"# One\ntext\n## Two\nmore") == [("text", "section 1", "One"), ("more", "section 2", "Two")]
    assert files.extract(".json", b'{"a": 1}')[0][0] == '{\n "a": 1\n}'
    assert "Hello" in files.extract(".rtf", rb"{\rtf1\ansi {\fonttbl{\f0 Arial;}}Hello\par World}")[0][0]
    m = files.extract(".eml", b"From: a@b.example\nSubject: Hi\nContent-Type: text/plain\n\nBody text")
    assert "Body text" in m[0][0] and m[0][2] == "Hi"
    assert files.decode("é".encode("cp1252")) == "é" and files.decode("﻿a".encode("utf-16")) == "a"
    with pytest.raises(ValueError):
        files.extract(".pdf", b"x")


def test_office_files():
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Text</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    assert files.extract(".docx", b.getvalue()) == [("Text\na | b", "", "Head")]
    assert files.extract(".xlsx", xlsx())[0][0].startswith("City: Oslo | Total: 2")
    with pytest.raises(ValueError):
        sheets._xml(b'<!DOCTYPE a [<!ENTITY x "y">]><a/>')


def test_walk_and_extract(spark, tmp_path):
    for n, t in (("a.md", "# H\nsome text"), ("~$b.md", "lock"), ("c.tmp", "x"), ("d.exe", "x"), ("empty.txt", ""), (".git/e.md", "no"), ("bad.docx", "no zip")):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_text(t)
    w = files.walk(spark, str(tmp_path))
    assert sorted(r.path.rsplit("/", 1)[1] for r in w.collect()) == ["a.md", "bad.docx"]
    got = {r.path.rsplit("/", 1)[1]: r for r in files.extract_files(spark, w).collect()}
    assert got["a.md"].text == "some text" and got["bad.docx"].error and got["bad.docx"].text is None


def test_headers_dates_and_kinds_of_columns():
    assert sheets.header_row(sheets._codes([["Report"], [], ["Name", "Day", "No"], ["a", "2025-01-02", "7"], ["b", "03/04/2025", "8"]])) == 2
    assert sheets.header_row(sheets._codes([["1", "2"], ["3", "4"]])) is None and sheets.header_row(sheets._codes([["a", "b"]])) is None and sheets.header_row(sheets._codes([])) is None
    days = {"2025-07-04": (2025, 7, 4), "04-Jul-2025": (2025, 7, 4), "31/12/2025": (2025, 12, 31), "12/31/2025": (2025, 12, 31), "4/7/2025": (2025, 7, 4), "2025/07/04": (2025, 7, 4)}
    assert all((d := sheets._moment(t)) and (d.year, d.month, d.day) == want for t, want in days.items())
    assert sheets._moment("2025-02-30") is None and sheets._moment("04-Xyz-2025") is None and sheets._moment("2025-07-04 10:11:12").second == 12

    def kind(label, *cells):
        p = sheets.probe("s", [[label, "note"], *[[c, "some words here"] for c in cells]])
        return p.columns[0].type, p.columns[0].role

    assert kind("Amount", "1,200", "7") == ("INTEGER", "number") and kind("Amount", "1.5", "7") == ("REAL", "number")
    assert kind("Order No", "1", "2") == ("TEXT", "id") and kind("Weight no", "1", "2") == ("INTEGER", "number") and kind("x", "007", "8") == ("TEXT", "id")
    assert kind("Day", *["2025-01-02"] * 9, "soon") == ("TEXT", "date") and kind("City", "Ulm", "Bonn") == ("TEXT", "category")
    assert kind("Text", *[f"{i} " + "long words " * 9 for i in range(50)]) == ("TEXT", "text")
    assert not sheets.probe("s", []).ok and not sheets.probe("s", [[None, " "]]).ok


def test_lines_are_numbered_over_blocks(spark, tmp_path):
    rows = ["name,day"] + [f"n{i},2025-01-{1 + i % 28:02d}" if i % 7 else "" for i in range(4000)]
    (tmp_path / "b.csv").write_text("\n".join(rows) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        df, _ = sheets.read_csv(spark, str(tmp_path / "b.csv"))
        assert df.rdd.getNumPartitions() > 3
        got = {r._row: r.name for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {i + 2: f"n{i}" for i in range(4000) if i % 7}


@pytest.mark.parametrize("sql,want", [("select '/* a */' as x", "/* a */"), ("select 'a\n -- b' as x", "a\n -- b"), ("select /* it's */ 'b' as x -- ' end", "b"), ("select \"--c\" as x", "--c"), ("select 'it''s /* x' as x /* y */", "it's /* x")])
def test_comments_and_literals(spark, sql, want):
    r = guard.run_sql(spark, sql)
    assert r.ok and r.rows == [[want]]


def test_capped_categories_keep_their_order(spark):
    d = spark.createDataFrame([(i, f"c{9 - i}", float(v)) for i, v in enumerate((1, -9, 3, 8, 2))], "at int, label string, v double")
    assert [(r.label, r.place) for r in present.cap_categories(d, "label", "v", 3, "at").collect()] == [("c8", 1), ("c7", 2), ("c6", 3)]
