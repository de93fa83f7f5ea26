"""Column functions on null, empty, malformed and very long texts."""

import pytest
from pyspark.sql import functions as F

from draftlake.functions import text as X

LONG = "层" * 50_000


def one(spark, make, *texts):
    rows = [(k, t) for k, t in enumerate(texts)]
    return [r["v"] for r in spark.createDataFrame(rows, "k int, t string").select("k", make(F.col("t")).alias("v")).orderBy("k").collect()]


CASES = {
    "chinese_to_int": (X.chinese_to_int, {
        "十": 10, "十二": 12, "二十": 20, "二十三": 23, "首": 1, "负一": -1, "地下二": -2, "一百": 100, "一百零五": 105, "一百一十": 110, "三千零二十": 3020, "一千": 1000, "零": 0, "7": 7, "-12": -12,
        "一万": 10000, "十万零三": 100003, "二十三万四千五百六十七": 234567, "一千零一万": 10010000, "负三万零一十": -30010, "九千九百九十九万九千九百九十九": 99999999, "万": None, "一二": 12, "十十": None, "abc": None, "": None, None: None, LONG: None,
    }),
    "first_number": (X.first_number, {"约 12.5 米": 12.5, "-3": -3.0, "a": None, "": None, None: None, "1.": 1.0, "9" * 400: float("inf"), LONG + "5": 5.0}),
    "digits_only": (X.digits_only, {"a1b2": 12, "": None, "无": None, None: None, "9" * 30: None}),
    "clean_value": (X.clean_value, {"名称：甲，乙": "甲", "a 至 b": "b", "": "", None: None, "x\ny": "x", "一;二": "一"}),
    "parse_date": (X.parse_date, {"2024-01-01": "2024年01月01日", "2024/1/31": "2024年01月31日", "2024年3月5日": "2024年03月05日", "20240101": None, "2024-13-01": None, "2023-02-29": None, "": None, None: None}),
    "squeeze_lines": (X.squeeze_lines, {"a\nb": "a\nb", "a\n\n\n": "a", "": "", None: None, "\n" * 1000: ""}),
    "parse_elevation": (X.parse_elevation, {"%%p0.000": 0.0, "-3.600": -3.6, "%%P5.5": 5.5, "x": 0.0, "": 0.0, None: 0.0}),
    "is_area_text": (X.is_area_text, {"本层建筑面积：5": True, "面积": False, "": False, None: False, LONG: False, LONG + "建筑面积": True}),
    "floor_keys": (X.floor_keys, {
        "一层平面图": ["1层平面图"], "A- 二至四层平面图": ["2层平面图", "3层平面图", "4层平面图"], "一、三层平面图": ["1层平面图", "3层平面图"], "地下一层平面图": ["-1层平面图"], "三~一层平面图": [], "屋顶层平面图": ["屋顶层平面图"], "说明": [], "": [], None: None, LONG: [],
    }),
    "apply_default": (lambda c: X.apply_default(c, "d"), {"": "d", None: "d", "x": "x", "0": "0"}),
    "parse_reply": (lambda c: X.parse_reply(c, "a"), {'<output>```json{"a": "x"}```</output>': "x", "<output>{</output>": None, "": None, None: None, '{"a": 5}': "5", '{"b": 1}': None}),
    "pick_listed": (lambda c: X.pick_listed(c, ["甲", "乙"]), {"有乙和甲": "甲", "丙": "丙", "": "", None: None}),
    "is_number": (X.is_number, {"1e3": True, " 5 ": True, "五": False, "": False, None: False}),
    "special_floors": (lambda c: F.transform(X.special_floors(c), lambda r: r["floor"]), {"地下2层共30平方米": [-2], "地上三层5平方米，地下1层6平方米": [3, -1], "": [], None: None}),
}


@pytest.mark.parametrize("name", CASES)
def test_function(spark, name):
    make, cases = CASES[name]
    assert dict(zip(cases, one(spark, make, *cases), strict=True)) == cases


def test_two_columns(spark):
    df = spark.createDataFrame([("2024年01月01日", "2024年01月31日"), ("x", None)], "a string, b string")
    assert [r[0] for r in df.select(X.period_days(F.col("a"), F.col("b"))).collect()] == [31, None]
    df = spark.createDataFrame([("耐火等级__级地下室耐火等级___级", ["一"]), ("", []), (None, ["x"]), ("__", [])], "t string, v array<string>")
    assert [r[0] for r in df.select(X.fill_blanks(F.col("t"), F.col("v"))).collect()] == ["耐火等级一级地下室耐火等级___级", "", None, "__"]
