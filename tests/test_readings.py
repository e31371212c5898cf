import io
import random
import tarfile
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace import catalog
from millrace.operators import alignment as A
from millrace.operators import apply as P
from millrace.operators import arbitration as V
from millrace.operators import detail as D
from millrace.operators import dictionary as M
from millrace.operators import evaluation as E
from millrace.operators import evidence as G
from millrace.operators import extraction as X
from millrace.operators import rules
from millrace.sinks import export as K
from millrace.sources import documents as S
from millrace.streaming import leases


def pairs(spark, left, right, keys, fallback=True):
    """Rows as dictionaries of text in, row numbers of the pairs out."""
    columns = list(dict.fromkeys(c for row in [*left, *right] for c in row))
    schema = "doc long, n long, " + ", ".join(f"`{c}` string" for c in columns)
    frames = [spark.createDataFrame([(1, i, *[row.get(c) for c in columns]) for i, row in enumerate(rows)], schema) for rows in (left, right)]
    got = A.align(*[df.withColumn("id", F.col("n").cast("string")) for df in frames], "doc", ["n"], keys, ["id", *columns], fallback)
    return [(None if r["id"] is None else int(r["id"]), None if r["other_id"] is None else int(r["other_id"])) for r in got.orderBy("pair").collect()]


def test_rows_in_pairs(spark):
    keys = {"item": "text", "code": "edi", "day": "date"}
    label = [{"item": "식대", "code": "DN001", "day": "20210808"}, {"item": "식대", "code": "DN001", "day": "20210810"}]
    read = [{"item": "식대", "code": "CN001", "day": "20210808"}, {"item": "식대", "code": "DN001", "day": "2021.08.10"}]
    assert pairs(spark, label, read, keys) == [(0, 0), (1, 1)]
    names = {"item": "text"}
    assert pairs(spark, [{"item": "주사료_행위료"}, {"item": "주사료_약품비"}], [{"item": "주사료"}, {"item": "주사료"}], names) == [(0, 0), (1, 1)]
    assert pairs(spark, [{"item": "입원료"}], [{"item": "수액"}], names, fallback=False) == [(0, None), (None, 0)]
    assert pairs(spark, [{"item": "입원료"}, {"item": ""}], [{"item": "수액"}], names) == [(0, 0), (1, None)]
    left = [{"item": "이학요법료", "name": "표층열치료", "total": "954.5"}, {"item": "이학요법료", "name": "간섭파전류치료", "total": "4232"}]
    assert pairs(spark, left, left[::-1], names) == [(0, 1), (1, 0)]
    assert pairs(spark, [], [{"item": "a"}], names) == [(None, 0)] and pairs(spark, [{"item": None}], [], names) == [(0, None)]


def test_differences_of_rows(spark):
    schema = "doc long, pair long, has_left boolean, has_right boolean, item string, paid string, other_item string, other_paid string"
    rows = [(1, 0, True, True, "초음파진단료", "1000", "(기본항목)초음파진단료", "1,000"), (1, 1, True, True, "식대", None, "식대", "0"), (1, 2, True, True, "식대", "5", "식대", "6")]
    got = A.row_diff(spark.createDataFrame(rows, schema), "doc", {"item": "text", "paid": "amount"}).collect()
    assert [(r["pair"], r["column"], r["own"], r["other"]) for r in got] == [(2, "paid", "5", "6")]
    body = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "doc long, seq long, name string")
    totals = spark.createDataFrame([(1, 0, 5, "sum a"), (1, None, 6, "head")], "doc long, anchor long, seq long, name string")
    assert [r["name"] for r in V.with_totals(body, totals).orderBy("place").collect()] == ["head", "a", "sum a", "b"]


def test_dictionary(spark):
    entries = [("KCD", "M81.99", "상세불명의 골다공증, 상세불명 부분"), ("EDI", "KK054", "정맥내 점적주사"), ("EDI", "kk-054", "둘째 이름"), ("EDI", "642902710", "약"), ("EDI", "64290", "다른 약"), ("KCD", "M81", "골다공증")]
    names = M.build(spark.createDataFrame([(*e, i) for i, e in enumerate(entries)], "system string, code string, name string, at int"), "at")
    cells = [("KCD", "M8199"), ("EDI", "KK054000"), ("EDI", "KK05"), ("EDI", "642902711"), ("KCD", "M815"), ("EDI", None)]
    got = M.lookup(spark.createDataFrame(cells, "system string, code string"), names, F.col("system"), "code").collect()
    found = {(r["system"], r["code"]): r["names"] for r in got}
    assert found == {cells[0]: [entries[0][2]], cells[1]: ["정맥내 점적주사", "둘째 이름"], cells[2]: None, cells[3]: None, cells[4]: None, cells[5]: None}
    mend = [("정맥내 점석 주사", ["정맥내 점적주사"], "정맥내 점적 주사"), ("정맥내점적주사", ["정맥내 점적주사"], None), ("정맥외 점석주사", ["정맥내 점적주사"], None), ("abd", ["xyz", "abc", "abe"], "abc"), ("abc", ["abd", "ABC"], None), (None, ["a"], None)]
    df = spark.createDataFrame(mend, "name string, names array<string>, wanted string")
    assert [r for r in df.withColumn("got", M.corrected_name(F.col("name"), F.col("names"))).collect() if r["got"] != r["wanted"]] == []


def _copies(tmp_path, spark, name, key, least):
    """A folder with a table of sf0.001 whose keys begin at `least`."""
    spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").withColumn(key, F.col(key) + least).write.parquet(str(tmp_path / f"{name}.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    return con


@pytest.mark.parametrize("name, least", [("dictionary_names", 199_990), ("dictionary_truncate", 199_990), ("normalize_edi", 12_450), ("prefix_lookup", 1_000_000)])
def test_parts_with_long_keys(spark, tmp_path, name, least):
    """Codes that hold only the first digits of long keys, and codes that begin with other codes."""
    con = _copies(tmp_path, spark, "part", "p_partkey", least)
    more = spark.read.parquet(str(tmp_path / "part.parquet"))
    if name == "normalize_edi":
        more.withColumn("p_partkey", F.expr("p_partkey div 10")).distinct().write.mode("append").parquet(str(tmp_path / "part.parquet"))
        con.execute(f"CREATE OR REPLACE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    wanted = con.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in wanted.description]
    assert sorted(map(tuple, catalog.queries()[name](spark, str(tmp_path)).select(columns).collect()), key=repr) == sorted(wanted.fetchall(), key=repr)


def test_references_in_headings(spark, tmp_path):
    """References beside the three that the SQL reads, and ones that are cut off."""
    html = "<h1>a &lt;b&gt; &quot;c&quot; &amp;lt; d&amp;&amp</h1><p>x</p><h2>&nbsp;e &#65;</h2>"
    spark.createDataFrame([(1, html), (2, None)], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    wanted = con.execute(catalog.oracle_sql()["html_parsed"]).fetchall()
    assert sorted(map(tuple, catalog.queries()["html_parsed"](spark, str(tmp_path)).collect())) == sorted(wanted)
    assert [b[1] for b in S.html_blocks(html)] == ['a <b> "c" &lt; d&&', "x", "e A"]


def test_html_and_grids():
    html = "<html><head><title>x</title></head><body><script>var a='<p>';</script><h2>청구서</h2><p>병원: <b>ABC</b> Hospital</p><table><tr><th rowspan=2>항목</th><th colspan=2>급여</th></tr><tr><td>본인</td><td>공단</td></tr><tr><td>진찰료<td>4,593<td>10,717</table>tail"
    blocks = S.html_blocks(html)
    assert [(b[0], b[1]) for b in blocks] == [("heading", "청구서"), ("text", "병원: ABC Hospital"), ("table", ""), ("text", "tail")]
    assert blocks[2][2] == [["항목", "급여", "급여"], ["항목", "본인", "공단"], ["진찰료", "4,593", "10,717"]] and blocks[2][3] == [[0, 0, 2, 1], [0, 1, 1, 2]]
    assert S.grid([[("a", 9, 1), ("b", 1, 1)], [("c", 1, 1)]]) == ([["a", "b"], ["a", "c"]], [[0, 0, 2, 1]])
    assert S.first_table("<p>x</p><table><tr><td>1</td></tr></table><table><tr><td>2</td></tr></table>") == [["1"]] and S.first_table("none") == []


def _zip(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        for name, text in files.items():
            book.writestr(name.replace("__", "/"), text)
    return out.getvalue()


def test_files_to_blocks(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    docx = _zip(**{"word__document.xml": f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t> </w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'})
    s, r = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    sheet = f'<worksheet {s}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5</v></c></row><row><c r="A2"/></row><row><c r="B3" t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>'
    xlsx = _zip(**{"xl__workbook.xml": f'<workbook {s} {r}><sheets><sheet name="one" r:id="rId1"/></sheets></workbook>', "xl__sharedStrings.xml": f"<sst {s}><si><t>a</t></si></sst>", "xl__worksheets__s1.xml": sheet,
        "xl___rels__workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/s1.xml"/></Relationships>'})
    files = {"a.txt": b"one\r\n\r\n two\x0bthree\xe2\x80\xa8four\xff", "b.csv": "﻿x,y\n\"1,2\",3\n".encode(), "c.html": b"<h1>H</h1>", "d.docx": docx, "e.xlsx": xlsx, "f.pdf": b"x", "g.txt": b" \n", "h.xlsx": b"broken"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {}
    for row in S.read(spark, str(tmp_path)).orderBy("path", "block").collect():
        got.setdefault(row["path"].rsplit("/", 1)[1], []).append((row["type"], row["text"], row["rows"]))
    assert [x[1] for x in got["a.txt"]] == ["one", "two", "three", "four�"] and got["b.csv"] == [("table", "", [["x", "y"], ["1,2", "3"]])] and got["c.html"] == [("heading", "H", None)]
    assert got["d.docx"] == [("heading", "Title", None), ("table", "", [["c"]])] and got["e.xlsx"] == [("table", "one", [["a", "", "5"], ["", "in"]])]
    assert [got[x][0][0] for x in ("f.pdf", "g.txt", "h.xlsx")] == ["error"] * 3


def test_code_lists(spark):
    member = "A00,콜레라\nA00,콜레라\n,x\nB1,이름\n".encode("cp949")
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as archive:
        info = tarfile.TarInfo("list.csv")
        info.size = len(member)
        archive.addfile(info, io.BytesIO(member))
    files = spark.createDataFrame([("x.csv", bytearray(member)), ("y.tar.gz", bytearray(out.getvalue())), ("z.bin", bytearray(b""))], "path string, content binary")
    assert [(r["path"], r["code"], r["name"]) for r in S.code_list(files).orderBy("path", "line").collect()] == [(p, c, n) for p in ("x.csv", "y.tar.gz") for c, n in (("A00", "콜레라"), ("B1", "이름"))]


def test_page_packing_against_a_loop(spark):
    r = random.Random(3)
    rows, wanted = [], {}
    for doc in range(40):
        blocks = [(doc, r.choice([0, 0, 1, 2]) + i // 4, i, r.randrange(1, 60)) for i in range(r.randrange(1, 25))]
        rows += blocks
        pages, chunks, fill = [], [], 0
        for b in blocks:
            if not pages or pages[-1][0][1] != b[1]:
                pages.append([])
            pages[-1].append(b)
        for page in pages:
            size = sum(b[3] for b in page)
            if size > 100:
                sub, sub_fill = None, 0
                for b in page:
                    if sub is None or sub_fill + b[3] > 100:
                        sub, sub_fill = [], 0
                        chunks.append(sub)
                    sub.append(b)
                    sub_fill += b[3]
                fill = None
            elif fill is None or not chunks or fill + size > 100:
                chunks.append(list(page))
                fill = size
            else:
                chunks[-1] += page
                fill += size
        for c, chunk in enumerate(chunks):
            for b in chunk:
                wanted[doc, b[1], c] = wanted.get((doc, b[1], c), 0) + 1
    got = X.page_chunks(spark.createDataFrame(rows, "doc long, page long, block long, size long"), "doc", "page", "block", "size", 100)
    assert {(x["doc"], x["page"], x["chunk"]): x["n"] for x in got.collect()} == wanted


def test_schemas_and_extraction(spark):
    made = X.generate_schema("환자 이름, 총 금액과 Total price 추출해줘")
    assert [(k, v["type"]) for k, v in made["properties"].items()] == [("환자_이름", "string"), ("총_금액", "number"), ("total_price", "number")]
    assert list(X.generate_schema("", ["Hospital ", "Date"])["properties"]) == ["hospital", "date"] and list(X.generate_schema("")["properties"]) == ["value"]
    schema = {"properties": {"hospital": {"type": "string", "title": "Hospital"}, "total_amount": {"type": "number", "title": "Total Amount"}, "ok": {"type": "boolean"}, "note": {"type": "string"}}}
    texts = spark.createDataFrame([(1, "Hospital: ABC Hospital\nTotal Amount: 120,000 won\nok: 예\n"), (2, None)], "doc long, text string")
    got = {(r["doc"], r["field"]): (r["value"], r["confidence"]) for r in X.local_extract(texts, schema).collect()}
    assert [got[1, f] for f in schema["properties"]] == [("ABC Hospital", 0.82), ("120000.0", 0.82), ("true", 0.82), (None, 0.0)] and got[2, "hospital"] == (None, 0.0)


def test_evidence(spark):
    values = spark.createDataFrame([(1, 0, "12380"), (1, 1, "합계금액은"), (1, 2, "not here"), (1, 3, "2023-01-02"), (1, 4, "성형외과의원"), (1, 5, None), (1, 6, "97318")], "doc long, value_id long, value string")
    cells = spark.createDataFrame([(1, 0, "12,380"), (1, 1, "112380"), (1, 2, "여기 합계금액은 다"), (1, 3, "2023.01.02"), (1, 4, "성헝외과의원"), (2, 0, "12380"), (1, 5, "97-318")], "doc long, row long, cell string")
    assert {(r["value_id"], r["row"], r["rank"]) for r in G.ranked(values, cells).collect()} == {(0, 0, 2), (1, 2, 1), (3, 3, 2), (6, 5, 2)}
    close = spark.createDataFrame([(1, 0, "정형외과의원이름")], "doc long, value_id long, value string")
    assert {(r["row"], r["rank"]) for r in G.ranked(close, spark.createDataFrame([(1, 7, "정헝외과의원이름")], "doc long, row long, cell string")).collect()} == {(7, 1)}
    hits = spark.createDataFrame([(1, i, v, r) for i, v, r in ((0, 0, 4), (0, 0, 2), (0, 1, 2), (1, 2, 2), (1, 3, 3), (2, 4, 2), (2, 5, 2), (2, 5, 9))], "doc long, item long, value_id long, row long")
    assert {r["item"]: r["row"] for r in G.agreed_rows(hits).collect()} == {0: 2, 1: 3, 2: 2}
    leaf = spark.createDataFrame([(1, 0, 0, "a"), (1, 1, 2, "b"), (1, 1, 9, "c"), (1, 1, 3, None)], "doc long, item long, value_id long, value string")
    assert {r["value_id"]: (r["row"], r["confidence"]) for r in G.leaves(leaf, hits, G.agreed_rows(hits)).collect()} == {0: (2, 1.0), 2: (2, 0.5), 9: (None, 0.0), 3: (3, 0.0)}


def test_verdicts_and_balance(spark):
    rows = [("amount", None, "0"), ("amount", "", "5"), ("amount", "10", "10원"), ("amount", "10", None), ("text", "정형외과 의원", "정형외과의원"), ("text", None, None)]
    judged = E.verdicts(spark.createDataFrame(rows, "kind string, label string, given string"), ["amount"]).collect()
    assert [r["verdict"] for r in judged] == ["skip", "fp", "correct", "wrong", "correct", "skip"] and [r["strict"] for r in judged] == [False, False, True, False, False, True]
    chosen = [(1, "a", "5", "5", "9", "one"), (1, "b", "4000", "4000", None, "one"), (1, "t", "4209", "4209", "4009", "one"), (2, "a", "500", "500", "100", "one"), (2, "b", "1", "1", "7", "one"), (2, "t", "101", "101", None, "one")]
    got = V.balanced(spark.createDataFrame(chosen, "doc long, key string, value string, one string, two string, source string"), {"t": ("a", "b")}).collect()
    assert {(r["doc"], r["key"]): (r["value"], r["source"]) for r in got} == {(1, "a"): (5, "one"), (1, "b"): (4000, "one"), (1, "t"): (4009, "two"), (2, "a"): (100, "two"), (2, "b"): (1, "one"), (2, "t"): (101, "one")}


def test_detail_rows(spark):
    schema = "doc long, row long, price string, dose string, times string, days string, total string, own string, fund string, full_own string, covered boolean"
    rows = [(1, 0, "1000", None, "1", "3", "3000"), (1, 1, "13", "0.5", "1", "1", "7"), (2, 0, "1000", None, "1", "3", "2000"), *[(3, i, "850", None, "1", "1", "1020") for i in range(3)], (3, 3, "500", None, "1", "1", "500"), (4, 0, "10", None, "1", "1", None)]
    frame = spark.createDataFrame([(*r, None, None, None, True) for r in rows] + [(5, 0, "1", None, "1", "1000", "1000", "100", "300", None, True)], schema)
    assert {(f["doc"], f["row"]) for f in D.row_arithmetic(frame).collect()} == {(2, 0), (5, 0)}


def test_export(spark, tmp_path):
    schema = "hospital string, items array<struct<name:string,qty:int,note:struct<organic:boolean>>>, tags array<string>, none array<struct<a:int>>"
    rows = K.table_rows(spark.createDataFrame([("H", [("apple", 2, None), ("pear", 1, (True,))], ["a", "b"], None), ("J", [], None, None)], schema))
    assert rows.columns == ["row", "hospital", "items.name", "items.qty", "items.note.organic", "tags", "none.a"]
    assert [tuple(r) for r in rows.collect()] == [(0, "H", "apple", 2, None, '["a","b"]', None), (1, "H", "pear", 1, True, '["a","b"]', None), (0, "J", None, None, None, None, None)]
    both = K.table([spark.createDataFrame([(1, None)], "a int, b string"), spark.createDataFrame([("x", 2)], "c string, a int")])
    assert both.columns == ["a", "b", "c"] and sorted(tuple(r) for r in both.collect()) == [("1", "", ""), ("2", "", "x")]
    K.write(both, str(tmp_path / "out"), "csv")
    assert spark.read.option("header", "true").csv(str(tmp_path / "out")).count() == 2
    with pytest.raises(ValueError):
        K.write(both, str(tmp_path / "out"), "pdf")


EVENTS = [
    (1, 0, "enqueue", None, 0), (1, 1, "claim", "a", 1), (1, 2, "claim", "b", 2), (1, 3, "heartbeat", "a", 500), (1, 4, "claim", "b", 900), (1, 5, "claim", "b", 1200), (1, 6, "finish", "a", 1300), (1, 7, "finish", "b", 1400),
    (2, 8, "claim", "a", 0), (2, 9, "enqueue", None, 1), (2, 10, "claim", "a", 2), (2, 11, "fail", "a", 3), (2, 12, "claim", "b", 4), (2, 13, "enqueue", None, 5),
]


def test_leases_in_a_batch_and_in_a_stream(spark, tmp_path):
    events = spark.createDataFrame(EVENTS, "doc long, event_id long, kind string, worker string, s long").withColumn("at", F.timestamp_seconds("s")).drop("s")
    batch = {r["event_id"]: (r["granted"], r["status"], r["attempts"]) for r in leases.claims(events).collect()}
    assert [batch[i] for i in range(8)] == [(None, "queued", 0), (True, "running", 1), (False, "running", 1), (None, "running", 1), (False, "running", 1), (True, "running", 2), (None, "running", 2), (None, "done", 2)]
    assert [batch[i][0] for i in range(8, 14)] == [False, None, True, None, True, None] and batch[13] == (None, "running", 2)
    for part, low in enumerate((0, 5, 10)):
        events.where(f"event_id >= {low} and event_id < {low + 5}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = leases.claims(stream).writeStream.format("memory").queryName("decided").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r["event_id"]: (r["granted"], r["status"], r["attempts"]) for r in spark.table("decided").collect()} == batch


def test_edits_moves_and_files(spark):
    cells = spark.createDataFrame([(1, 0, "진찰료"), (1, 1, "abcdefgh"), (1, 2, ""), (1, 3, "abcdefgh"), (1, 4, "12")], "doc long, cell_no long, text string")
    edits = spark.createDataFrame([(1, 0, "진칠료"), (1, 1, "abcdefgx"), (1, 2, "new"), (1, 3, "zzzzzzzz"), (1, 4, " ")], "doc long, cell_no long, text string")
    assert {r["cell_no"]: r["text"] for r in P.accepted_edits(cells, edits).collect()} == {0: "진칠료", 1: "abcdefgx", 2: "", 3: "abcdefgh", 4: "12"}
    moves = [(1, 0, "a", "b"), (1, 1, "a", "b"), (1, 2, "c", "d"), (1, 0, "e", "f"), (1, 1, "e", "f"), (1, 2, "e", "g")]
    assert [tuple(r) for r in P.column_moves(spark.createDataFrame(moves, "doc long, row long, column string, target string")).collect()] == [(1, "a", "b")]
    grids = spark.createDataFrame([([["a"], ["b"], ["c"]], [["x"], ["y"]]), ([["a"], ["b"], ["c"]], [["x"]]), (None, None)], "read array<array<string>>, ruled array<array<string>>")
    assert [len(r[0] or []) for r in grids.select(P.better_grid(F.col("read"), F.col("ruled"))).collect()] == [2, 3, 0]
    files = spark.createDataFrame([("new/a", bytearray(b"x")), ("new/b", bytearray(b"y"))], "path string, content binary")
    sha = "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"
    records = spark.createDataFrame([(1, "old/a", sha, "new/a"), (2, "old/b", sha, "new/b"), (3, "old/c", sha, "new/c")], "key long, path string, sha256 string, to string")
    assert {r["key"]: (r["path"], r["moved"]) for r in P.relocated(records, files).collect()} == {1: ("new/a", True), 2: ("old/b", False), 3: ("old/c", False)}
    drift = E.manifest_drift(records.select(F.col("to").alias("path"), "sha256"), files)
    assert {r["path"]: r["reason"] for r in drift.collect()} == {"new/b": "changed", "new/c": "missing"}
    with pytest.raises(ValueError):
        P.restrict(spark.createDataFrame([("a", "1")], "key string, value string"), ["x"], ["a"])
    empty = files.where("false")
    assert P.migrated(spark.createDataFrame([("a\0b",)], "s string"), empty).first()[0] == "ab"
    with pytest.raises(ValueError):
        P.migrated(empty, files)


def test_bands_and_labels(spark):
    lines = [(1, 0, 0, 10.0, 0.0, 20.0, 10.0), (1, 0, 1, 10.0, 100.0, 20.0, 110.0), (1, 1, 2, 0.0, 98.0, 5.0, 108.0)]
    frame = spark.createDataFrame(lines, "page long, value_id long, line long, x0 double, y0 double, x1 double, y1 double")
    assert G.band(frame.withColumnRenamed("page", "doc"), ["doc"]).collect()[0]["band"] == 103.0
    near = G.nearest_centre(frame.withColumnRenamed("page", "doc"), G.band(frame.withColumnRenamed("page", "doc"), ["doc"]), ["doc"])
    assert {r["value_id"]: r["line"] for r in near.collect()} == {0: 1, 1: 2}
    anchors = spark.createDataFrame([(1, 0, 9, 5.0, 96.0, 104.0), (1, 1, 2, 0.0, 98.0, 108.0)], "page long, value_id long, anchor long, x0 double, y0 double, y1 double")
    assert {r["value_id"]: r["line"] for r in G.labelled(frame, anchors, ["page"], 1).collect()} == {0: 1}


def test_two_sides_of_an_evaluation(spark):
    cells = "doc long, key string, value string"
    both = E.two_sides(spark.createDataFrame([(1, "a", "5")], cells), spark.createDataFrame([(1, "b", "6")], cells), spark.createDataFrame([(1, "a", "5", "amount"), (1, "c", "7", "amount")], cells + ", kind string"), ["doc", "key"])
    assert {r["key"]: (r["first"], r["last"], r["label"]) for r in both.collect()} == {"a": ("5", None, "5"), "b": (None, "6", None), "c": (None, None, "7")}
    rows = spark.createDataFrame([(1, "합계"), (1, "x"), (2, "합계")], "doc long, name string")
    assert sorted(tuple(r) for r in E.without_totals(rows, rows.where("doc = 2"), "doc", "name").collect()) == [(1, "x"), (2, "합계")]
    assert [r[0] for r in spark.createDataFrame([("None",), ("x",), (None,)], "v string").select(E.nullish(F.col("v"))).collect()] == [None, "x", None]


def test_windows_of_event_time(spark):
    events = spark.createDataFrame([("a", 0), ("a", 3599), ("b", 3600)], "kind string, s long").withColumn("at", F.timestamp_seconds("s"))
    assert sorted((r["kind"], r["n"]) for r in leases.windowed(events, "at", "kind").collect()) == [("a", 2), ("b", 1)]


def test_exact_evidence(spark, monkeypatch):
    r = random.Random(5)
    word = lambda: r.choice(["a", "bb", "ccc", "d,", "ee."])
    items = [(i, " ".join(word() for _ in range(r.randrange(1, 9)))) for i in range(60)] + [(60, None), (61, "")]
    docs = [(d, "x".join(r.choice(items)[1] or "" for _ in range(3)) + r.choice(["", "\n", "y"]) + " ".join(word() for _ in range(30))) for d in range(60)] + [(60, None), (61, "")]
    wanted = {(d, i) for d, t in docs for i, n in items if t and n and len(n.split()) >= 3 and n in t}
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for most in (20_000, 3):
        monkeypatch.setattr(rules, "ANCHORS", most)
        got = rules.exact_evidence(*frames).collect()
        assert {tuple(x) for x in got} == wanted and len(got) == len(wanted) > 50
    assert rules.exact_evidence(frames[0], frames[1].where("false")).collect() == []
