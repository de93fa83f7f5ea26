"""Column functions on texts of drawings and documents.  Null in, null out, unless said."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values
DIGITS = "零一二三四五六七八九"
AREA_PHRASES = ["本层建筑面积", "本层总建筑面积", "计容面积", "总建筑面积:", "层建筑面积", "本层面积"]
STRUCTURE_TYPES = ["框架结构", "剪力墙结构", "框架剪力墙结构", "钢结构", "筒体结构", "混合结构"]
SCALE = r"^1:[0-9]{2,4}$"
ELEVATION = r"^(?:%%[pP])?-?\d+(?:\.\d+)$"
LIFT = r"电梯DT(\d+)"
UNDERGROUND_AREA = r"地.*?[:：]\s*([0-9]+(?:\.[0-9]+)?)\s*平方米"
SPECIAL_FLOOR = r"地([上下])([0-9零一二三四五六七八九十]+)层[^平]*平方米"


def count_of(text: Column, key: Column) -> Column:
    """Occurrences of key that do not overlap."""
    return F.floor((F.length(text) - F.length(F.replace(text, key, F.lit("")))) / F.length(key)).cast("long")


def chinese_to_int(text: Column) -> Column:
    """Numerals below a hundred million, 首 as 1, digits as they are; 负 and 地下 (or a minus) make it negative; else null."""
    minus = text.rlike("^(负|地下|-)")
    body = F.regexp_replace(F.regexp_replace(text, "^(负|地下|[-+])", ""), "首", "一")
    plain = F.translate(body, "零一二三四五六七八九", "0123456789")
    part = r"(?:(\d)?千)?0?(?:(\d)?百)?0?(?:(\d)?十)?0?(\d)?"

    def below(four: Column) -> Column:
        """The value of a numeral below ten thousand."""
        places = [F.when(four.contains(unit), F.coalesce(F.nullif(F.regexp_extract(four, rf"(\d?){unit}", 1), F.lit("")).cast("int"), F.lit(1)) * value).otherwise(0) for unit, value in (("千", 1000), ("百", 100), ("十", 10))]
        ones = F.coalesce(F.nullif(F.regexp_extract(four, r"(?:^|[十百千]|0)(\d)$", 1), F.lit("")).cast("int"), F.lit(0))
        return places[0] + places[1] + places[2] + ones

    high, low = F.regexp_extract(plain, "^(.*)万", 1), F.regexp_extract(plain, "([^万]*)$", 1)
    value = F.when(plain.rlike(r"^\d+$"), plain.try_cast("int")).when(plain.rlike(f"^{part}$") & (plain != ""), below(plain))
    value = value.when(plain.rlike(f"^{part}万{part}$") & (high != ""), below(high) * 10000 + below(low))
    return F.when(minus, -value).otherwise(value)


def first_number(text: Column) -> Column:
    return F.regexp_extract(text, r"-?\d+\.?\d*", 0).try_cast("double")


def digits_only(text: Column) -> Column:
    """All digits joined; null where there are none."""
    return F.regexp_replace(text, "[^0-9]", "").try_cast("long")


def clean_value(text: Column) -> Column:
    """Up to the first comma or semicolon, without spaces, first line, behind the last colon and the last 至."""
    cut = F.regexp_replace(text, r"(?s)[，,;；].*$", "")
    line = F.substring_index(F.replace(cut, F.lit(" "), F.lit("")), "\n", 1)
    return F.substring_index(F.regexp_replace(line, "^.*[:：]", ""), "至", -1)


def parse_date(text: Column) -> Column:
    """A date in one of three forms as YYYY年MM月DD日; else null."""
    forms = ((r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"), (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"), (r"^\d{4}年\d{1,2}月\d{1,2}日$", "yyyy年M月d日"))
    return F.date_format(F.coalesce(*(F.try_to_timestamp(F.when(text.rlike(p), text), F.lit(f)) for p, f in forms)), "yyyy年MM月dd日")


def as_date(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit("yyyy年MM月dd日")).cast("date")


def period_days(start: Column, end: Column) -> Column:
    """Days from start to end, both counted."""
    return F.datediff(as_date(end), as_date(start)) + 1


def add_days(start: Column, days: Column) -> Column:
    return F.date_format(F.date_add(as_date(start), days), "yyyy年MM月dd日")


def reconcile(computed: Column, document: Column, share: float, replace: bool) -> tuple[Column, Column]:
    """(value, candidate): the document's value; a computed one off by share or more replaces it or stands beside it.  0 counts as absent."""
    doc, own = F.nullif(document, F.lit(0.0)), F.nullif(computed, F.lit(0.0))
    off = F.coalesce(F.abs(own - doc) / F.abs(doc) >= share, F.lit(False))
    value = F.when(off & F.lit(replace), own).otherwise(F.coalesce(doc, own))
    return value, F.when(off, doc if replace else own)


def category_label(value: Column, names: dict[str, str], suffix: str) -> Column:
    """Synonyms replaced, then the suffix set once."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    mapped = F.coalesce(table[value], value) if names else value
    return F.concat(F.regexp_replace(mapped, f"{re.escape(suffix)}$", ""), F.lit(suffix))


def apply_default(value: Column, default: str | None, zero_is_missing: bool = False) -> Column:
    """Missing and empty texts as the default; a true 0 stays unless told otherwise."""
    v = F.nullif(value, F.lit(""))
    if zero_is_missing:
        v = F.when(v.try_cast("double") == 0, None).otherwise(v)
    return F.coalesce(v, F.lit(default))


def fill_blanks(text: Column, values: Column) -> Column:
    """Runs of two or more underscores replaced by the values in turn; runs beyond them stay."""
    parts, runs = F.split(text, "_{2,}", -1), F.regexp_extract_all(text, F.lit("(_{2,})"), 1)
    fill = F.transform(runs, lambda r, i: F.when(i < F.size(values), F.get(values, i)).otherwise(r))
    return F.array_join(F.zip_with(parts, F.concat(fill, F.array(F.lit(""))), lambda p, f: F.concat(p, f)), "")


def parse_reply(text: Column, field: str) -> Column:
    """The field of the JSON between <output> tags, code marks stripped; null if it is no JSON."""
    inner = F.substring_index(F.substring_index(text, "<output>", -1), "</output>", 1)
    return F.try_variant_get(F.try_parse_json(F.trim(F.regexp_replace(inner, "`|json", ""))), f"$.{field}", "string")


def squeeze_lines(text: Column) -> Column:
    """Without line feeds where they are 40 % of the characters or more."""
    bare = F.replace(text, F.lit("\n"), F.lit(""))
    return F.when((F.length(text) - F.length(bare)) >= 0.4 * F.length(text), bare).otherwise(text)


def parse_elevation(text: Column) -> Column:
    """The signed number behind an optional %%p; 0 where there is none."""
    return F.coalesce(F.trim(F.regexp_replace(text, "%%[pP]", "")).try_cast("double"), F.lit(0.0))


def is_number(text: Column) -> Column:
    return text.try_cast("double").isNotNull()


def pick_listed(text: Column, listed: list[str]) -> Column:
    """The first listed word in the text, else the text."""
    return F.coalesce(F.get(F.filter(F.array(*map(F.lit, listed)), lambda w: F.contains(text, w)), F.lit(0)), text)


def shift_spans(spans: Column, n: int) -> Column:
    return F.transform(spans, lambda x: x + n)


def is_area_text(text: Column) -> Column:
    return F.coalesce(F.exists(F.array(*map(F.lit, AREA_PHRASES)), lambda p: F.contains(text, p)), F.lit(False))


def special_floors(text: Column) -> Column:
    """Records 地上N层…平方米 and 地下N层…平方米: signed floor and text."""
    found = F.regexp_extract_all(text, F.lit(f"({SPECIAL_FLOOR})"), 1)
    return F.transform(found, lambda r: F.struct((chinese_to_int(F.regexp_extract(r, SPECIAL_FLOOR, 2)) * F.when(F.regexp_extract(r, SPECIAL_FLOOR, 1) == "下", -1).otherwise(1)).alias("floor"), r.alias("record")))


def floor_keys(label: Column) -> Column:
    """The floors of a drawing title as keys: single, 、 lists, ~ and 至 ranges, odd and even, mezzanine, roofs; empty if it is none."""
    text = F.element_at(F.split(F.replace(label, F.lit(" "), F.lit("")), "-", -1), -1)
    one = "(?:负|地下)?[首零一二三四五六七八九十0-9]+层?"
    level = F.replace(F.regexp_extract(text, f"({one}(?:[、~至]{one})*)(?:组合)?(?:(?:夹|奇数|偶数)层)?(?:地下室平时|平时平面图|地下室|平面图)", 1), F.lit("层"), F.lit(""))
    roof = F.regexp_extract(text, "((?:屋顶设备|屋顶|构架|屋面|天面)层?平面图)", 1)
    spans = F.split(F.when(F.contains(level, F.lit("至")), F.regexp_replace(level, "至", "~")).otherwise(level), "、")
    parity = F.when(F.contains(text, F.lit("奇数")), 1).when(F.contains(text, F.lit("偶数")), 0)

    def numbers(s: Column) -> Column:
        low, high = chinese_to_int(F.substring_index(s, "~", 1)), chinese_to_int(F.substring_index(s, "~", -1))
        return F.filter(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>")), lambda n: parity.isNull() | (F.pmod(n, F.lit(2)) == parity) | (low == high))

    mezzanine = F.when(F.contains(text, F.lit("夹层")), "层夹层平面图").otherwise("层平面图")
    keys = F.transform(F.flatten(F.transform(spans, numbers)), lambda n: F.concat(n.cast("string"), mezzanine))
    return F.when(level != "", keys).when(roof != "", F.array(roof)).when(label.isNotNull(), F.array().cast("array<string>"))
