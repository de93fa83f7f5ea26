"""Queries on text functions.

Where a query parses a text that it first builds from numbers, its SQL gives those numbers.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.evidence import occurrences
from .fixtures import duck, frame
from .registry import query


def numeral(n):
    """Chinese numeral of 1 to 99."""
    digit = lambda k: F.substring(F.lit(X.DIGITS), k + 1, F.lit(1))
    tens, ones = F.floor(n / 10).cast("int"), (n % 10).cast("int")
    return F.concat(F.when(tens > 1, digit(tens)).otherwise(""), F.when(tens > 0, "十").otherwise(""), F.when(ones > 0, digit(ones)).otherwise(""))


_KEY, _PRE, _POST = " the ", 10, 50


@query("keyword_window", duck(f"""WITH p AS (SELECT doc_id, text, string_split(text, '{_KEY}') AS ps FROM {{documents}}),
    u AS (SELECT doc_id, text, len(ps) AS n, unnest(ps) AS piece, unnest(range(1, len(ps) + 1)) AS i FROM p),
    o AS (SELECT doc_id, text, n, i, CAST(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) + {len(_KEY)} * (i - 1) AS o FROM u)
    SELECT doc_id, CAST(i - 1 AS INT) AS seq, substr(text, greatest(o - {_PRE}, 0) + 1, o + {len(_KEY) + _POST} - greatest(o - {_PRE}, 0)) AS snippet FROM o WHERE i < n"""))
def keyword_window(spark, sf):
    """Every occurrence of a key with its surroundings, numbered within its text."""
    hits = occurrences(frame(spark, sf, "documents").select("doc_id", "text"), [_KEY], _PRE, _POST)
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1
    return hits.select("doc_id", seq.alias("seq"), F.col("window").alias("snippet"))


_NUMERALS = "一二三四五六七八九"


def _big_numeral(n: str) -> str:
    """SQL of the Chinese numeral of a number below a hundred million; both engines run it."""

    def four(n: str) -> str:
        digit = lambda d: f"substr('{_NUMERALS}', CAST({d} AS INT), 1)"
        place = lambda v: f"CAST(floor({n} / {v}) AS BIGINT) % 10"
        one = lambda v, unit: f"CASE WHEN {place(v)} > 0 THEN concat({digit(place(v))}, '{unit}') WHEN {n} > {v * 10} AND {n} % {v} > 0 AND {place(v * 10)} > 0 THEN '零' ELSE '' END"
        return f"concat({one(1000, '千')}, {one(100, '百')}, {one(10, '十')}, CASE WHEN {n} % 10 > 0 THEN {digit(n + ' % 10')} ELSE '' END)"

    high, low = f"CAST(floor({n} / 10000) AS BIGINT)", f"({n} % 10000)"
    return f"CASE WHEN {n} >= 10000 THEN concat({four(high)}, '万', CASE WHEN {low} > 0 AND {low} < 1000 THEN '零' ELSE '' END, {four(low)}) ELSE {four(n)} END"


_BIG = "(o_orderkey * 7919) % 99999999 + 1"


@query("chinese_to_int", duck(f"SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN -({_BIG}) ELSE {_BIG} END AS value FROM {{orders}}"))
def chinese_to_int(spark, sf):
    sign = "CASE o_orderkey % 6 WHEN 0 THEN '负' WHEN 3 THEN '地下' ELSE '' END"
    return frame(spark, sf, "orders").selectExpr("o_orderkey", f"concat({sign}, {_big_numeral('(' + _BIG + ')')}) AS text").select("o_orderkey", X.chinese_to_int(F.col("text")).cast("long").alias("value"))


@query("expand_floor_label", duck("""SELECT p_partkey, concat(f, CASE WHEN p_size % 11 = 0 AND p_size % 5 <> 0 THEN '层夹层平面图' ELSE '层平面图' END) AS floor_key
    FROM (SELECT p_partkey, p_size, unnest(CASE WHEN p_size % 5 = 0 THEN range(p_size, p_size + 4) WHEN p_size % 7 = 0 THEN list_filter(range(p_size, p_size + 7), lambda n: n % 2 = 1) ELSE [p_size] END) AS f FROM {part})"""))
def expand_floor_label(spark, sf):
    n = F.col("p_size")
    label = F.when(n % 5 == 0, F.concat(F.lit("A- "), numeral(n), F.lit("至"), numeral(n + 3), F.lit("层平面图"))).when(n % 7 == 0, F.concat(numeral(n), F.lit("~"), numeral(n + 6), F.lit("层奇数层平面图")))
    label = label.when(n % 11 == 0, F.concat(numeral(n), F.lit("层夹层平面图"))).otherwise(F.concat(numeral(n), F.lit("层 平面图")))
    return frame(spark, sf, "part").select("p_partkey", F.explode(X.floor_keys(label)).alias("floor_key"))


@query("first_number", duck("SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE round(o_totalprice, 1) - 200000 END AS value FROM {orders}"))
def first_number(spark, sf):
    text = F.when(F.col("o_orderkey") % 9 == 0, "面积不详").otherwise(F.concat(F.lit("约 "), F.format_string("%.1f", F.round(F.col("o_totalprice"), 1) - 200000), F.lit(" 平方米 12")))
    return frame(spark, sf, "orders").select("o_orderkey", X.first_number(text).alias("value"))


@query("digits_only", duck("SELECT c_custkey, TRY_CAST(regexp_replace(c_name, '[^0-9]', '', 'g') AS BIGINT) AS value FROM {customer}"))
def digits_only(spark, sf):
    return frame(spark, sf, "customer").select("c_custkey", X.digits_only(F.col("c_name")).alias("value"))


@query("clean_value", duck("SELECT p_partkey, replace(p_name, ' ', '') AS value FROM {part}"))
def clean_value(spark, sf):
    text = F.concat(F.lit("名 称：旧：自甲至"), F.col("p_name"), F.lit("\n第二行；其余，不要"))
    return frame(spark, sf, "part").select("p_partkey", X.clean_value(text).alias("value"))


@query("parse_date", duck("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE strftime(o_orderdate, '%Y年%m月%d日') END AS value FROM {orders}"))
def parse_date(spark, sf):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    text = F.when(k == 0, F.date_format(d, "yyyy-M-d")).when(k == 1, F.date_format(d, "yyyy/MM/d")).when(k == 2, F.date_format(d, "yyyy年M月dd日")).otherwise(F.date_format(d, "yyyyMMdd"))
    return frame(spark, sf, "orders").select("o_orderkey", X.parse_date(text).alias("value"))


@query("period_days", duck("SELECT o_orderkey, CAST(o_orderkey % 900 + 1 AS INT) AS days FROM {orders}"))
def period_days(spark, sf):
    start = F.date_format("o_orderdate", "yyyy年MM月dd日")
    end = F.date_format(F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 900).cast("int")), "yyyy年MM月dd日")
    return frame(spark, sf, "orders").select("o_orderkey", X.period_days(start, end).alias("days"))


@query("add_days", duck("SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE) + CAST(o_custkey % 700 AS INT), '%Y年%m月%d日') AS value FROM {orders}"))
def add_days(spark, sf):
    return frame(spark, sf, "orders").select("o_orderkey", X.add_days(F.date_format("o_orderdate", "yyyy年MM月dd日"), (F.col("o_custkey") % 700).cast("int")).alias("value"))


@query("derive_arithmetic", duck("SELECT p_partkey, p_retailprice - p_size AS landscape, CASE WHEN p_size % 10 = 0 THEN NULL ELSE concat(printf('%.2f', p_retailprice / (p_size % 10) * 100), '%') END AS rate, p_size * 3 - p_size AS ordinary FROM {part}"))
def derive_arithmetic(spark, sf):
    rate = F.try_divide(F.col("p_retailprice"), F.nullif(F.col("p_size") % 10, F.lit(0))) * 100
    return frame(spark, sf, "part").select("p_partkey", (F.col("p_retailprice") - F.col("p_size")).alias("landscape"), F.when(rate.isNotNull(), F.format_string("%.2f%%", rate)).alias("rate"), (F.col("p_size") * 3 - F.col("p_size")).alias("ordinary"))


@query("reconcile", duck("""SELECT p_partkey, CASE WHEN d IS NULL THEN c WHEN c IS NOT NULL AND abs(c - d) / d >= 0.2 THEN c ELSE d END AS total, coalesce(d, c) AS above, CASE WHEN abs(c - d) / d >= 0.3 THEN c END AS above_candidate
    FROM (SELECT p_partkey, nullif(CAST(p_size % 9 AS DOUBLE), 0) AS c, nullif(CAST(p_partkey % 8 AS DOUBLE), 0) AS d FROM {part})"""))
def reconcile(spark, sf):
    c, d = (F.col("p_size") % 9).cast("double"), (F.col("p_partkey") % 8).cast("double")
    total, _ = X.reconcile(c, d, 0.2, True)
    above, candidate = X.reconcile(c, d, 0.3, False)
    return frame(spark, sf, "part").select("p_partkey", total.alias("total"), above.alias("above"), candidate.alias("above_candidate"))


@query("category_label", duck("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '教育建筑' WHEN 1 THEN '居住建筑' ELSE '商业建筑' END AS label FROM {part}"))
def category_label(spark, sf):
    raw = F.when(F.col("p_size") % 3 == 0, "学校").when(F.col("p_size") % 3 == 1, "居住建筑").otherwise("商业")
    return frame(spark, sf, "part").select("p_partkey", X.category_label(raw, {"学校": "教育建筑"}, "建筑").alias("label"))


@query("apply_default", duck("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN '-1' ELSE CAST(p_size % 5 AS VARCHAR) END AS value, CASE WHEN p_size % 4 = 0 OR p_size % 5 = 0 THEN '-1' ELSE CAST(p_size % 5 AS VARCHAR) END AS area FROM {part}"))
def apply_default(spark, sf):
    raw = F.when(F.col("p_size") % 4 == 0, F.when(F.col("p_size") % 8 == 0, "").otherwise(None)).otherwise((F.col("p_size") % 5).cast("string"))
    return frame(spark, sf, "part").select("p_partkey", X.apply_default(raw, "-1").alias("value"), X.apply_default(raw, "-1", True).alias("area"))


@query("fill_blanks", duck("SELECT p_partkey, concat('等级', p_brand, '级', CASE WHEN p_size % 2 = 0 THEN p_type ELSE '___' END, '类_') AS value FROM {part}"))
def fill_blanks(spark, sf):
    values = F.when(F.col("p_size") % 2 == 0, F.array("p_brand", "p_type")).otherwise(F.array("p_brand"))
    return frame(spark, sf, "part").select("p_partkey", X.fill_blanks(F.lit("等级__级___类_"), values).alias("value"))


@query("parse_reply", duck("SELECT p_partkey, CASE WHEN p_size % 6 = 0 THEN NULL ELSE p_name END AS value FROM {part}"))
def parse_reply(spark, sf):
    body = F.to_json(F.struct(F.col("p_name").alias("result")))
    text = F.concat(F.lit("好的<output>```json\n"), F.when(F.col("p_size") % 6 == 0, F.lit("{bad")).otherwise(body), F.lit("\n```</output>完"))
    return frame(spark, sf, "part").select("p_partkey", X.parse_reply(text, "result").alias("value"))


@query("squeeze_lines", duck("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'ab' ELSE concat('a', chr(10), p_name, chr(10)) END AS value FROM {part}"))
def squeeze_lines(spark, sf):
    text = F.when(F.col("p_size") % 2 == 0, F.lit("a\n\nb\n")).otherwise(F.concat(F.lit("a\n"), F.col("p_name"), F.lit("\n")))
    return frame(spark, sf, "part").select("p_partkey", X.squeeze_lines(text).alias("value"))


@query("parse_elevation", duck("SELECT ent_id, CAST(text AS DOUBLE) * CASE WHEN ent_id % 3 = 0 THEN -1 ELSE 1 END AS level FROM {number}"))
def parse_elevation(spark, sf):
    text = F.concat(F.when(F.col("ent_id") % 2 == 0, "%%p").otherwise(""), F.when(F.col("ent_id") % 3 == 0, "-").otherwise(""), F.col("text"))
    return frame(spark, sf, "number").select("ent_id", X.parse_elevation(text).alias("level"))


@query("is_number", duck("SELECT ent_id, ent_id % 4 <> 0 AS ok FROM {number}"))
def is_number(spark, sf):
    return frame(spark, sf, "number").select("ent_id", X.is_number(F.when(F.col("ent_id") % 4 == 0, F.concat("text", F.lit("m"))).otherwise(F.col("text"))).alias("ok"))


@query("pick_listed", duck("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '一级' WHEN 1 THEN '二级' ELSE '不详' END AS value FROM {part}"))
def pick_listed(spark, sf):
    text = F.when(F.col("p_size") % 3 == 0, "抗震等级为一级，局部二级").when(F.col("p_size") % 3 == 1, "等级二级").otherwise("不详")
    return frame(spark, sf, "part").select("p_partkey", X.pick_listed(text, ["一级", "二级", "三级", "四级"]).alias("value"))


@query("shift_spans", duck("SELECT p_partkey, [p_size + 12, p_size * 2 + 12] AS spans FROM {part}"))
def shift_spans(spark, sf):
    return frame(spark, sf, "part").select("p_partkey", X.shift_spans(F.array(F.col("p_size"), F.col("p_size") * 2), 12).alias("spans"))


@query("text_match", duck("SELECT ent_id, ent_id % 5 = 0 AS scale, ent_id % 5 IN (1, 2) AS elevation, CASE WHEN ent_id % 5 = 3 THEN CAST(ent_id AS VARCHAR) ELSE '' END AS lift FROM {ent}"))
def text_match(spark, sf):
    k, n = F.col("ent_id") % 5, F.col("ent_id").cast("string")
    text = F.when(k == 0, "1:150").when(k == 1, F.concat(F.lit("%%p-"), n, F.lit(".300"))).when(k == 2, F.concat(n, F.lit(".0"))).when(k == 3, F.concat(F.lit("电梯DT"), n)).otherwise(n)
    return frame(spark, sf, "ent").select("ent_id", text.rlike(X.SCALE).alias("scale"), text.rlike(X.ELEVATION).alias("elevation"), F.regexp_extract(text, X.LIFT, 1).alias("lift"))


@query("is_area_text", duck("SELECT ent_id, ent_id % 4 < 2 AS area FROM {ent}"))
def is_area_text(spark, sf):
    k = F.col("ent_id") % 4
    text = F.when(k == 0, "1.0本层建筑面积：667.12 M").when(k == 1, "总建筑面积: 12").when(k == 2, "总建筑面积 12").otherwise(None)
    return frame(spark, sf, "ent").select("ent_id", X.is_area_text(text).alias("area"))


@query("special_floor_record", duck("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN -p_size ELSE p_size END AS floor, concat(CASE WHEN p_partkey % 2 = 0 THEN '地下' ELSE '地上' END, p_size, '层面积为', p_partkey, '平方米') AS record FROM {part}"))
def special_floor_record(spark, sf):
    text = F.concat(F.lit("共计，"), F.when(F.col("p_partkey") % 2 == 0, "地下").otherwise("地上"), F.col("p_size").cast("string"), F.lit("层面积为"), F.col("p_partkey").cast("string"), F.lit("平方米。完"))
    return frame(spark, sf, "part").select("p_partkey", F.explode(X.special_floors(text)).alias("r")).select("p_partkey", "r.floor", "r.record")


@query("structure_windows", duck("SELECT block_id, no - (SELECT min(no) FROM {spec_class} WHERE field = 'structure_type') AS place, CAST((length(text) - length(replace(text, class, ''))) // length(class) AS BIGINT) AS n FROM {block} JOIN {spec_class} ON field = 'structure_type' AND contains(text, class)"))
def structure_windows(spark, sf):
    """How many windows each block has round each structure type."""
    hits = occurrences(frame(spark, sf, "block").select("block_id", "text"), X.STRUCTURE_TYPES, 30, 30)
    place = F.array_position(F.array(*map(F.lit, X.STRUCTURE_TYPES)), F.col("key")) - 1
    return hits.groupBy("block_id", place.cast("int").alias("place")).agg(F.count("window").alias("n"))


@query("count_distinct_codes", duck("SELECT p_size % 50 AS file, count(DISTINCT p_partkey % 13) AS n FROM {part} GROUP BY ALL"))
def count_distinct_codes(spark, sf):
    text = F.concat(F.lit("电梯DT"), (F.col("p_partkey") % 13).cast("string"), F.lit("|电梯DT"), (F.col("p_partkey") % 13).cast("string"))
    codes = frame(spark, sf, "part").select((F.col("p_size") % 50).alias("file"), F.explode(F.regexp_extract_all(text, F.lit(X.LIFT), 1)).alias("code"))
    return codes.groupBy("file").agg(F.count_distinct("code").alias("n"))
