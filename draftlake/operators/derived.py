"""Fields that are computed from other fields, in the order that their dependencies ask."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

#: Cities of the first two tiers; any other city is of the last one.
FIRST_TIER = ["北京市", "上海市", "广州市", "深圳市"]
SECOND_TIER = [
    "成都市", "重庆市", "杭州市", "武汉市", "苏州市", "西安市", "南京市", "长沙市", "天津市", "郑州市", "东莞市", "无锡市", "宁波市", "青岛市", "合肥市", "佛山市", "大连市", "福州市", "厦门市", "哈尔滨市",
    "济南市", "温州市", "南宁市", "长春市", "泉州市", "石家庄市", "贵阳市", "南昌市", "金华市", "常州市", "南通市", "嘉兴市", "太原市", "徐州市", "惠州市", "珠海市", "中山市", "台州市", "烟台市", "兰州市", "绍兴市", "海口市", "扬州市",
]
NO_CITY = "城市不存在"
UNDER_GROUND = "地下"
FIRST_LEVEL = "一级"
MISSING = -1.0

Formula = Callable[[dict[str, Column]], Column]


def stages(deps: dict[str, list[str]], given: set[str]) -> list[list[str]]:
    """Fields in levels: those of a level depend on given ones and on earlier levels only.  A cycle, or a field that is nowhere, is an error that names it."""
    if absent := sorted({d for ds in deps.values() for d in ds} - set(deps) - given):
        raise ValueError(f"fields that are not there: {', '.join(absent)}")
    left, done, out = dict(deps), set(given), []
    while left:
        level = [f for f, ds in left.items() if set(ds) <= done]
        if not level:
            raise ValueError(f"fields that depend on each other: {', '.join(left)}")
        out.append(level)
        done |= set(level)
        for f in level:
            del left[f]
    return out


def derive(df: DataFrame, deps: dict[str, list[str]], formulas: dict[str, Formula]) -> DataFrame:
    """df with the fields of deps as columns, one projection for each level.  A formula gets the columns that its field depends on."""
    for level in stages(deps, set(df.columns)):
        df = df.withColumns({f: formulas[f]({d: F.col(d) for d in deps[f]}) for f in level})
    return df


def _number(c: Column) -> Column:
    """A number other than 0, else null."""
    return F.nullif(c.cast("double"), F.lit(0.0))


def _total(areas: Column, below: bool) -> Column:
    """The areas of a map building -> area below or above ground."""
    picked = F.map_values(F.map_filter(areas, lambda k, v: F.contains(k, F.lit(UNDER_GROUND)) == F.lit(below)))
    return F.round(F.aggregate(picked, F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0))), 2)


def total_area(above: Column, below: Column) -> Column:
    """Their sum, missing if one is."""
    return F.coalesce(F.round(_number(above) + _number(below), 2), F.lit(MISSING))


def landscape(land: Column, base: Column) -> Column:
    return F.coalesce(land.cast("double") - F.coalesce(base.cast("double"), F.lit(0.0)), F.lit(MISSING))


def rate(part: Column, whole: Column) -> Column:
    """Percent with two digits, missing if one of them is."""
    return F.coalesce(F.round(_number(part) / _number(whole) * 100, 2), F.lit(MISSING))


def period(start: Column, end: Column) -> Column:
    """Days of two dates of any known form, both counted."""
    return X.period_days(X.parse_date(start), X.parse_date(end))


def tier(address: Column) -> Column:
    """The tier of the first city that an address names."""
    city = F.regexp_extract(address, "(" + "|".join([*FIRST_TIER, *SECOND_TIER]) + ")", 1)
    return F.when(city.isin(*FIRST_TIER), "一线城市").when(city != "", "二线城市").when(F.contains(address, F.lit("市")), "三四线城市").otherwise(NO_CITY)


def leading_level(levels: Column) -> Column:
    """The most frequent value of a map building -> level in the order of buildings; of several the one that had that many first; the first level of all if empty."""
    own = F.filter(F.transform(F.array_sort(F.map_entries(levels)), lambda e: e["value"]), lambda v: v.isNotNull())
    placed = F.transform(own, lambda v, k: F.struct(v.alias("v"), k.alias("k")))
    best = F.transform(F.array_distinct(own), lambda v: F.struct((-F.size(F.filter(own, lambda o: o == v))).alias("n"), F.array_max(F.transform(F.filter(placed, lambda p: p["v"] == v), lambda p: p["k"])).alias("last"), v.alias("v")))
    return F.coalesce(F.array_min(best)["v"], F.lit(FIRST_LEVEL))


#: How each field that the specs derive comes from those it depends on, by field id.
FORMULAS: dict[str, Formula] = {
    "above_ground_building_area": lambda c: _total(c["building_area"], False),
    "underground_building_area": lambda c: _total(c["building_area"], True),
    "total_building_area": lambda c: total_area(c["above_ground_building_area"], c["underground_building_area"]),
    "landscape_area": lambda c: landscape(c["land_area"], c["building_base_area"]),
    "greening_rate": lambda c: rate(c["greening_area"], c["land_area"]),
    "construction_period": lambda c: period(c["start_date"], c["completion_date"]),
    "construction_location_level": lambda c: tier(c["project_location"]),
    "earthquake_level": lambda c: leading_level(c["business_earthquake_level"]),
    "number_of_floors": lambda c: F.size("building_area").cast("long"),
}


def spec_deps(fields: list[tuple]) -> dict[str, list[str]]:
    """The dependencies of the specs, by field id."""
    ids = {f[0]: f[1] for f in fields}
    return {f[1]: [ids[d] for d in f[5]] for f in fields if f[5]}
