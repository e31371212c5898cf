import os

import duckdb
import pytest

from pyspark.sql import functions as F

from millrace import catalog
from millrace.functions import normalise as N

SF = "/root/testdata/sf0.001"


def _plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF}/{file}'")
    wanted = con.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in wanted.description]
    got = catalog.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    rows = [tuple(map(_plain, r)) for r in got.select(columns).collect()]
    assert sorted(rows, key=repr) == sorted((tuple(map(_plain, r)) for r in wanted.fetchall()), key=repr)


CASES = [
    (N.date, "2023-2-8", "20230208"), (N.date, "230228", "20230228"), (N.date, "50.1.1", "19500101"), (N.date, "49.1.1", "20490101"), (N.date, "2023.02.30", None),
    (N.date, "2O25.O1.l2", "20250112"), (N.date, "1234567890123", None), (N.date, None, None),
    (N.amount, "I2,3OO", "12300"), (N.amount, "B00", "800"), (N.amount, "954.5", "954.5"), (N.amount, "19160.0", "19160"), (N.amount, "1.234", "1234"),
    (N.amount, "△1,200", "-1200"), (N.amount, "-0", "0"), (N.amount, "-", None), (N.amount, None, None),
    (N.identity_number, "880101 - 1234567", "880101-1234567"), (N.identity_number, "abc", None), (N.disease_codes, "020.9", "D209"), (N.disease_codes, "163", "I63"),
    (N.label_key, "성 명: [x]", "성명x"), (N.text, " a \n b ", "a b"), (N.text, "--", None), (N.money, "△1,234.5", -1234), (N.tick, "☑", "Y"), (N.tick, "□", "N"), (N.tick, None, None), (N.tick, "[V]", "Y"), (N.tick, "true", "Y"), (N.tick, "예", "Y"), (N.tick, "Office", "N"), (N.tick, "", "N"),
    (N.is_total, "총합계", True), (N.is_total, "합계금액", True), (N.is_total, "subtotal", False), (N.present, "\n-\t", None), (N.present, "\u3000\u00a0x\u2003", "x"), (N.text, "a\u00a0\u3000b", "a b"),
    *[(N.date, a, b) for a, b in (("2023년 2월 28일", "20230228"), ("23.1.2", "20230102"), ("99.12.31", "19991231"), ("진단연월일: 2021/7/9", "20210709"), ("2023.02.29", None), ("2024.02.29", "20240229"), ("2025년 O1월 I2일", "20250112"), ("Oct 2025.01.12", "20250112"))],
    (lambda v: N.normalize("dates", v), "['20210819', '20210826', '2021.08.19']", "20210819, 20210826"), (lambda v: N.normalize("dates", v), "x", None),
    *[(N.amount, a, b) for a, b in (("12,380원", "12380"), ("b00", "600"), ("1ㅇㅇ", "100"), ("1이이", "100"), ("000", "0"), ("0012380", "12380"), ("676,782.5", "676782.5"), ("-42,360", "-42360"), ("−6", "-6"))],
    *[(N.number, a, b) for a, b in (("1,5", "1.5"), ("2 x 3", "6"), ("1.5x2", "3"), ("3회", "3"), ("없음", None), ("1,234", "1234"), ("0", "0"), (None, None))],
    *[(N.phone, a, b) for a, b in (("(02) 123-4567", "02-123-4567"), ("02-123-4567 / FAX 02-000-1111", "02-123-4567"), ("021234567", "02-123-4567"), ("15881234", "1588-1234"), ("031-111-2222-031-111-3333", "031-111-2222"), ("12-34", None))],
    (N.disease_codes, "S8260 M5136", "S8260, M5136"), (N.disease_codes, "j20.9", "J209"), (N.identity_number, "880101-1******", "880101-1******"),
    (lambda v: N.item_code(v)[0], "kk-05o4 ", "KK0504"), (lambda v: N.item_code(v)[0], "MX122S1", "MX122S1"), (lambda v: N.item_code(v)[1], "MX122S1", "MX12251"), (lambda v: N.item_code(v)[0], "가나", "가나"),
    (lambda v: N.choice(v, {"급여": ("보험",), "비급여": ("일반",)}), "비급여 항목", "비급여"), (lambda v: N.choice(v, {"남": ("남자", "m"), "여": ("여자", "f")}), "남 여", None), (lambda v: N.choice(v, {"남": ("남자", "m"), "여": ("여자", "f")}), "m", "남"),
    (N.person_name, "홍길동홍길동 (인)", "홍길동"), (N.person_name, "의사 김철수 제12345호", "김철수"), (N.person_name, "남여", None), (N.person_name, "치과", None),
    (N.hospital_name, "병원명: 한빛병 직인생략", "한빛병원"), (N.address, "주소: 서울시 강남구 1로 2 전화 02-123-4567", "서울시 강남구 1로 2"), (N.address, "123", None),
    (N.serial_number, "야간(공휴일)진료", None), (N.serial_number, "A-12345", "A-12345"), (N.serial_number, "20191024-M188", None), (lambda v: N.serial_number(v, False), "20191024-M188", "20191024-M188"), (N.serial_number, "2018 -", None),
    (N.ward, "내과혈액종양", None), (N.ward, "501호", "501호"), (N.letters_of, "각a", [4352, 4449, 4520, 97]), (N.needles, "2023-1-02", ["2023-1-02", "2023.1.02", "2023/1/02"]), (N.needles, "의원", ["의원", "의"]), (N.needles, "12.0", ["12.0", "12"]),
    (N.needles, "1,200.0원", ["1200.0원", "1200.0"]), (lambda v: N.misread_of(v, F.lit("치료재료대")), "치료제료다", True), (lambda v: N.misread_of(v, F.lit("주사료")), "검사로", False), (lambda v: N.misread_of(v, F.lit("abcd")), "abd", True),
    (N.is_total, "합 계:", True), (N.is_total, None, False), (N.several_amounts, "1,200 300", True), (N.several_amounts, "1,200", False),
    (lambda v: N.page_numbers(v, F.lit(6)), "5,1-3, 9", [1, 2, 3, 5]), (lambda v: N.page_numbers(v, F.lit(6)), "1-", None), (lambda v: N.page_numbers(v, F.lit(6)), "3-2", []),
    (N.present, "n/a", None), (N.present, " x ", "x"), (N.dictionary_key, "kk-05.4", "KK054"),
]


def test_normalisers(spark):
    for build, raw, wanted in CASES:
        df = spark.createDataFrame([(raw,)], "v string")
        assert df.select(build(df.v)).first()[0] == wanted, (build.__name__, raw)


SAME = [
    ("amount", None, "0", True), ("amount", "", "0원", True), ("number", None, "0", True), ("text", "(주상병)이상체중감소", "이상체중감소", True), ("text", "급성기관지염", "급성 기관지염(의증)", True), ("code", "R63.4", "R634", True),
    ("amount", None, "1000", False), ("text", None, "이상체중감소", False), ("text", "가", "가나다", False), ("text", "외과", "정형외과", False), ("text", "이상체중감소", "체중증가", False), ("text", "ABCDE", "abcde", False),
    ("dates", "2023.1.2 ~ 2023.1.5", "2023.1.5, 2023.1.2", True), ("text", None, "-", True), ("bool", None, "", False), ("bool", "V", "예", True),
]


def test_same(spark):
    for kind, a, b, wanted in SAME:
        df = spark.createDataFrame([(a, b)], "a string, b string")
        assert tuple(df.select(N.same(kind, df.a, df.b), N.same(kind, df.b, df.a)).first()) == (wanted, wanted), (kind, a, b)
    df = spark.createDataFrame([("ab, cd", "abcd")], "a string, b string")
    assert not df.select(N.same("text", df.a, df.b, strict=True)).first()[0]


def test_html_rows(spark):
    df = spark.createDataFrame([("<table><tr><th>a</th><td> b <b>c</b></td></tr><tr><td>4,593</td></tr></table>",), (None,)], "v string")
    assert [r[0] for r in df.select(N.html_rows(df.v)).collect()] == [[["a", "b c"], ["4,593"]], None]


def test_steps_are_made_once(spark):
    """A step that names its value several times does not copy its expression, however many steps follow."""
    v = F.col("v")
    for made in (N.money(N.present(v)), N.number_value(N.present(v)), N.same("text", v, F.col("w")), N.same("date", v, F.col("w"))):
        assert made._jc.toString().count("v") == 1
    df = spark.createDataFrame([("007",), ("-7",), ("1,2",), ("9" * 16,), ("x",), (None,)], "v string")
    assert [r[0] for r in df.select(N.money(df.v)).collect()] == [7, -7, 12, 10**16, None, None]
