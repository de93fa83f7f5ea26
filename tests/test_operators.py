"""Derived fields, nearest vectors, floor plans, project documents: by hand and by brute force."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from draftlake.functions.specs import FIELDS
from draftlake.operators import derived, layout
from draftlake.operators import documents as D
from draftlake.sources import results


def test_stages():
    assert derived.stages({"c": ["a", "b"], "b": ["a"], "d": ["x"]}, {"a", "x"}) == [["b", "d"], ["c"]]
    with pytest.raises(ValueError, match="depend on each other: a, b"):
        derived.stages({"a": ["b"], "b": ["a"], "c": []}, set())
    with pytest.raises(ValueError, match="not there: z"):
        derived.stages({"a": ["z"]}, set())
    deps = derived.spec_deps(FIELDS)
    given = {d for ds in deps.values() for d in ds} - set(deps)
    levels = derived.stages(deps, given)
    assert set(deps) == set(derived.FORMULAS) and levels[1] == ["total_building_area"] and len(levels) == 2


def test_derived_fields(spark):
    rows = [
        (1, 100.0, 30.0, 25.0, "2024-01-01", "2024/1/31", {"地下室": 10.5, "A": 20.25, "B": None}, {"A": "二级", "B": "三级", "C": "三级", "D": "二级"}, "深圳市南山"),
        (2, 0.0, None, 5.0, "someday", "2024-01-01", {"A": 3.0}, {}, "某市"),
        (3, None, 1.0, None, None, None, {}, None, None),
        (4, 10.0, None, 0.0, "2024年3月1日", "2024年3月1日", {"地下一层": 1.0, "地下二层": 2.0}, {"A": "四级", "B": None}, "乡下"),
    ]
    df = spark.createDataFrame(rows, "id int, land_area double, building_base_area double, greening_area double, start_date string, completion_date string, building_area map<string,double>, business_earthquake_level map<string,string>, project_location string")
    got = {r["id"]: r for r in derived.derive(df, derived.spec_deps(FIELDS), derived.FORMULAS).collect()}
    of = lambda k: tuple(got[k][c] for c in ("above_ground_building_area", "underground_building_area", "total_building_area", "landscape_area", "greening_rate", "construction_period", "construction_location_level", "earthquake_level"))
    assert of(1) == (20.25, 10.5, 30.75, 70.0, 25.0, 31, "一线城市", "三级")
    assert of(2) == (3.0, 0.0, -1.0, 0.0, -1.0, None, "三四线城市", "一级")
    assert of(3)[:6] == (0.0, 0.0, -1.0, -1.0, -1.0, None) and of(3)[7] == "一级"
    assert of(4) == (0.0, 3.0, -1.0, 10.0, -1.0, 1, "城市不存在", "四级")


def test_nearest_by_brute_force(spark):
    r = np.random.default_rng(1)
    vectors = {k: r.normal(size=6) for k in range(60)} | {100: np.zeros(6), 101: r.normal(size=3)}
    vectors |= {200: vectors[5] * 2, 201: vectors[5]}
    rows = [(k, v.tolist()) for k, v in vectors.items()] + [(300, None), (301, [None] * 6), (302, [float("nan")] * 6)]
    corpus = spark.createDataFrame(rows, "id long, vector array<double>")
    queries = corpus.filter("id % 5 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    unit = {k: v / np.linalg.norm(v) for k, v in vectors.items() if v.any()}
    for least in (None, 0.3):
        want = set()
        for q in (k for k in unit if k % 5 == 0):
            scored = sorted((-round(float(unit[q] @ v), 9), k) for k, v in unit.items() if len(v) == len(unit[q]))
            want |= {(q, k, n) for n, (s, k) in enumerate(scored[:7], 1) if least is None or -s >= least}
        got = {(x["query_id"], x["id"], x["rank"]) for x in D.nearest(queries, corpus, 7, least).collect()}
        assert got == want
    assert D.nearest(queries.limit(0), corpus, 3).count() == 0 == D.nearest(queries, corpus.limit(0), 3).count()


def test_retrieve_with_one_list_and_several(spark):
    lists = [(1, 0, "a", 1), (1, 0, "b", 2), (1, 0, "c", 3), (2, 0, "a", 1), (2, 0, "b", 2), (2, 3, "b", 1), (2, 3, "c", 2)]
    got = sorted(map(tuple, D.retrieve(spark.createDataFrame(lists, "query_id int, list int, id string, rank int"), 2).collect()))
    assert got == [(1, "a", 1), (1, "b", 2), (2, "a", 2), (2, "b", 1)]


def box(drawing, ent, text, x, y, w=100, h=10):
    return (drawing, ent, text, float(x), float(y), float(x + w), float(y + h))


def test_areas_of_floor_plans(spark):
    rows = [
        box(1, 1, "一", 0, 1000, 30), box(1, 2, "~", 30, 1000, 10), box(1, 3, "三层平面图", 40, 1000, 60), box(1, 4, "本层建筑面积：12.5 M", 20, 900),
        box(1, 10, "五层平面图", 5000, 1000), box(1, 11, "本层建筑面积", 5000, 900), box(1, 12, "：", 5110, 901, 5, 8), box(1, 13, "7.5", 5120, 901, 30, 8), box(1, 14, "9.9", 5200, 901, 30, 8),
        box(1, 20, "地下一层平面图", 9000, 3000), box(1, 21, "层建筑面积", 9000, 2900), box(1, 22, "text", 9010, 2800, 20), box(1, 23, "4.25", 9010, -1900, 20), box(1, 24, "1.0", 9010, -2050, 20),
        box(2, 30, "屋顶层平面图", 0, 0), box(2, 31, "本层建筑面积：3", 0, -50), box(3, 40, "二层平面图", 0, 0), box(3, 41, None, 0, -50),
    ]
    texts = spark.createDataFrame(rows, "drawing_id long, ent_id long, text string, minx double, miny double, maxx double, maxy double")
    got = sorted((r["drawing_id"], r["floor"], r["area"], r["filled"]) for r in layout.floor_areas(layout.labelled_areas(texts)).collect())
    assert got == [(1, -1, 4.25, False), (1, 0, 4.25, True), (1, 1, 12.5, False), (1, 2, 12.5, False), (1, 3, 12.5, False), (1, 4, 12.5, True), (1, 5, 7.5, False)]


def test_layouts_stand_in(spark):
    rows = spark.createDataFrame([(1, "own"), (7, "x"), (7, "y"), (8, "z")], "drawing_id int, v string")
    layouts = spark.createDataFrame([(1, 1, 7), (2, 1, 6), (2, 2, 7), (2, 3, 8), (3, 1, 6)], "drawing_id int, layout int, child_id int")
    drawings = spark.createDataFrame([(1,), (2,), (3,), (4,)], "drawing_id int")
    got = sorted((r["drawing_id"], r["layout"], r["v"]) for r in layout.with_layouts(drawings, layouts, rows).collect())
    assert got == [(1, 0, "own"), (2, 2, "x"), (2, 2, "y")]


def test_project_documents(spark, tmp_path):
    values = [("p1", "name", None, "学校", ["甲", "乙"]), ("p1", "kind", None, "", None), ("p1", "secret", None, "x", None), ("p1", "area", "A", "5", ["5", "6"]), ("p1", "area", "B", None, None), ("p1", "area", None, "lost", None), ("p2", "name", "A", "lost", None)]
    specs = [("name", "项目名称", True, False, "无"), ("kind", "类", True, False, "新建"), ("secret", "密", True, True, None), ("area", "面积", False, False, "-1")]
    df = results.project_documents(
        spark.createDataFrame(values, "project string, field string, building_type string, value string, candidates array<string>"),
        spark.createDataFrame(specs, "field string, name string, general boolean, hidden boolean, fallback string"), spark.createDataFrame([("p1", 12.6)], "project string, seconds double"),
    )
    results.write_results(df, str(tmp_path / "out"), 4)
    text = [json.loads(line) for f in (tmp_path / "out").rglob("part-*") for line in f.read_text().splitlines()]
    one = next(d for d in text if d["project_name"] == "p1")
    assert one["general"] == {"name": {"chinese_name": "项目名称", "value": "学校", "candidates": ["甲", "乙"]}, "kind": {"chinese_name": "类", "value": "新建", "candidates": []}}
    assert one["business_type"] == {"area": {"chinese_name": "面积", "types": {"A": {"value": "5", "candidates": ["5", "6"]}, "B": {"value": "-1", "candidates": []}}}} and one["case_time"] == 13
    assert next(d for d in text if d["project_name"] == "p2") == {"project_name": "p2", "general": {}, "business_type": {}, "case_time": None}
    assert sorted(r["project_name"] for r in results.read_results(spark, str(tmp_path / "out")).collect()) == ["p1", "p2"]


def test_order_of_scores_does_not_hang_on_blocks(spark, monkeypatch):
    from draftlake.operators import nearest as N

    r = random.Random(2)
    rows = [(k, [r.choice([-1.0, 0.5, 1.0]) for _ in range(4)]) for k in range(120)]
    corpus = spark.createDataFrame(rows, "id long, vector array<double>")
    q = corpus.filter("id < 9").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    whole = sorted(map(tuple, D.nearest(q, corpus, 9).collect()))
    monkeypatch.setattr(N, "BLOCK", 10)
    monkeypatch.setattr(N, "QUERY_BLOCK", 2)
    assert sorted(map(tuple, D.nearest(q, corpus, 9).collect())) == whole
