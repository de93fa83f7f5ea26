"""First matches in cells, against every pair; and that no pair is ever a row."""

import random

import numpy as np
import pytest

from draftlake.operators import firsts, greedy, layout


def boxes(r, n):
    rows = []
    for k in range(n):
        x, y = r.randrange(-2000, 2000), r.randrange(-2000, 2000)
        rows.append((k % 2, k, x, y, x + r.choice((0, 5, 700, 3000)), y + r.choice((0, 5, 400, 2500)), ":" if k % 5 == 0 else f"t{k}"))
    return rows


@pytest.fixture
def texts(spark):
    rows = boxes(random.Random(3), 160)
    return rows, spark.createDataFrame(rows, "drawing_id long, ent_id long, minx long, miny long, maxx long, maxy long, text string")


def best(rows, suits, order):
    found = {}
    for a in rows:
        hit = [b for b in rows if b[0] == a[0] and suits(a, b)]
        if hit:
            found[a[1]] = min(hit, key=order)[1]
    return found


def rows_made(df):
    """The most rows that any operator of the plan made once it has run."""
    df.collect()
    most, plans = 0, [df._jdf.queryExecution().executedPlan()]
    while plans:
        plan = plans.pop()
        for more in ("executedPlan", "plan"):
            if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" and more == "executedPlan" or plan.getClass().getSimpleName().endswith("QueryStageExec") and more == "plan":
                plans.append(getattr(plan, more)())
        if plan.metrics().contains("numOutputRows"):
            most = max(most, plan.metrics().apply("numOutputRows").value())
        children = plan.children()
        plans += [children.apply(k) for k in range(children.size())]
    return most


def test_first_hits_looks_at_all_rows():
    for n in (0, 1, 40, 9000):
        got = firsts.first_hits(n, np.array([0, n // 2, n]), lambda i, j: j[:, :] >= np.array([n - 1, n, 0])[i, None])
        assert got.tolist() == [n - 1, -1, -1]


def test_below_header(spark, texts):
    rows, df = texts
    for reach in (5000, 300):
        top = best(rows, lambda a, b: b[5] < a[3] and a[2] <= b[2] <= a[4], lambda b: (-b[5], b[1]))
        want = {k: v for k, v in top.items() if rows[v][5] >= rows[k][3] - reach}
        assert {r["header_id"]: r["value_id"] for r in layout.below_header(df, df, reach).collect()} == want and want


def test_right_of(spark, texts):
    rows, df = texts
    want = best(rows, lambda a, b: b[6] != ":" and b[2] > a[4] and b[3] >= a[3] and b[5] <= a[5], lambda b: (b[2], b[1]))
    assert {r["key_id"]: r["value_id"] for r in layout.right_of(df, df).collect()} == want and want


def test_nearest_area(spark, texts):
    rows, df = texts
    want = best(rows, lambda a, b: abs(b[3] - a[3]) <= 200 and a[2] - 500 <= b[2] <= a[4] + 500, lambda b: (-b[5], b[1]))
    assert {r["label_id"]: r["area_id"] for r in layout.nearest_area(df, df, 10, 100).collect()} == want and want


def test_mark_numbers(spark, texts):
    rows, df = texts
    poles = df.selectExpr("drawing_id", "ent_id AS id", "minx", "maxx", "maxy AS y")
    suits = lambda a, b: b[2] >= a[2] - (a[4] - a[2]) * 0.25 and b[4] <= a[4] + (a[4] - a[2]) * 0.25 and (b[3] >= a[5] or b[5] >= a[5])
    want = best(rows, suits, lambda b: (b[3], b[1]))
    got = greedy.mark_numbers(poles, df).collect()
    assert {r["id"]: r["ent_id"] for r in got} == want and want
    assert all(r["text"] == rows[r["ent_id"]][6] for r in got)


def test_no_pair_is_a_row(spark):
    """One place of a drawing that holds 300 boxes, each of which suits each: 90,000 pairs."""
    same = spark.range(300).selectExpr("1L AS drawing_id", "id AS ent_id", "id AS minx", "0L AS miny", "2000 + id AS maxx", "9L AS maxy", "'7' AS text")
    poles = same.selectExpr("drawing_id", "ent_id AS id", "minx", "maxx", "1L AS y")
    higher = same.selectExpr("drawing_id", "ent_id", "0L AS minx", "20L AS miny", "2000L AS maxx", "29L AS maxy", "text")
    for df in (greedy.mark_numbers(poles, same), layout.below_header(higher, same), layout.nearest_area(same, same, 10, 100)):
        assert rows_made(df) < 5000
