"""Tables of the drawing model, derived from the given ones by arithmetic that Spark and DuckDB share.

Each text is SQL over the given tables, whose names stand in braces.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..functions import specs as S
from ..functions.text import STRUCTURE_TYPES


def values(rows: list[tuple], columns: str) -> str:
    """A table of fixed rows as SQL; the first column numbers them."""
    text = lambda x: "CAST(NULL AS STRING)" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, (k, *r))) + ')' for k, r in enumerate(rows))}) AS t(no, {columns})"


_TYPES = [("structure_type", n, word, word) for n, word in enumerate(STRUCTURE_TYPES)]
_ONES = "substr('一二三四五六七八九', CAST({n} % 10 AS INT), 1)"


def numeral(n: str) -> str:
    """SQL of the Chinese numeral of 1 to 99."""
    tens = f"CAST(floor({n} / 10) AS INT)"
    return f"concat(CASE WHEN {n} >= 20 THEN substr('一二三四五六七八九', {tens}, 1) ELSE '' END, CASE WHEN {n} >= 10 THEN '十' ELSE '' END, CASE WHEN {n} % 10 > 0 THEN {_ONES.format(n=n)} ELSE '' END)"


_FILE = "CAST(floor(doc_id / 4) AS BIGINT)"
_NAME = re.compile(r"\{(\w+)\}")

TEXTS: dict[str, str] = {
    # Bounding boxes in 100 drawings.
    "ent": """SELECT o_orderkey % 100 AS drawing_id, o_orderkey AS ent_id,
        (o_custkey * 37 + o_orderkey * 11) % 10000 AS minx, (o_custkey * 53 + o_orderkey * 17) % 10000 AS miny,
        (o_custkey * 37 + o_orderkey * 11) % 10000 + 1 + (o_orderkey * 7) % 1500 AS maxx,
        (o_custkey * 53 + o_orderkey * 17) % 10000 + 1 + (o_orderkey * 13) % 1500 AS maxy
        FROM {orders}""",
    # The sides of the boxes; every seventh lacks its right one.
    "seg": """SELECT drawing_id, ent_id * 4 AS seg_id, 'V' AS kind, minx AS x1, miny AS y1, minx AS x2, maxy AS y2 FROM {ent}
        UNION ALL SELECT drawing_id, ent_id * 4 + 1, 'H', minx, maxy, maxx, maxy FROM {ent}
        UNION ALL SELECT drawing_id, ent_id * 4 + 2, 'V', maxx, miny, maxx, maxy FROM {ent} WHERE ent_id % 7 <> 0
        UNION ALL SELECT drawing_id, ent_id * 4 + 3, 'H', minx, miny, maxx, miny FROM {ent}""",
    # Text boxes: the boxes go round all documents, and those of one document share its whole text in equal parts.
    "share": """SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ent_id) AS part, count(*) OVER (PARTITION BY doc_id) AS parts
        FROM (SELECT *, ent_id % (SELECT max(doc_id) + 1 FROM {documents}) AS doc_id FROM {ent})""",
    "txt": """SELECT drawing_id, ent_id, minx, miny, maxx, maxy,
        substr(text, CAST(floor(length(text) * (part - 1) / parts) AS INT) + 1,
            CAST(floor(length(text) * part / parts) AS INT) - CAST(floor(length(text) * (part - 1) / parts) AS INT)) AS text
        FROM {share} JOIN {documents} USING (doc_id)""",
    # Elevation marks: two strokes, a pole (every fifth is missing) and a number above it.
    "stroke": """SELECT drawing_id, ent_id * 3 AS id, 'left' AS side, CAST(minx AS DOUBLE) AS minx, miny, CAST(minx + maxx AS DOUBLE) / 2 AS maxx, maxy FROM {ent}
        UNION ALL SELECT drawing_id, ent_id * 3 + 1, 'right', CAST(minx + maxx AS DOUBLE) / 2, miny, CAST(maxx AS DOUBLE), maxy FROM {ent}""",
    "pole": """SELECT drawing_id, ent_id * 3 + 2 AS id, minx, maxx + 50 AS maxx, maxy AS y FROM {ent} WHERE ent_id % 5 <> 0""",
    "number": """SELECT drawing_id, ent_id, minx + 1 AS minx, maxx AS maxx, maxy + 5 AS miny, maxy + 9 AS maxy,
        concat(CAST(floor((ent_id % 400) / 10) AS INT), '.', CAST(ent_id % 10 AS INT)) AS text FROM {ent}""",
    # Strokes and poles as the two-point lines that a drawing holds, and texts of which some are scales.
    "mark_line": """SELECT drawing_id, id, minx AS x1, maxy AS y1, maxx AS x2, miny AS y2 FROM {stroke} WHERE side = 'left'
        UNION ALL SELECT drawing_id, id, minx, miny, maxx, maxy FROM {stroke} WHERE side = 'right'
        UNION ALL SELECT drawing_id, id, CAST(minx AS DOUBLE), y, CAST(maxx AS DOUBLE), y FROM {pole}""",
    "scale": """SELECT drawing_id, ent_id, minx, miny, minx + 5 AS maxx, miny + 5 AS maxy,
        CASE ent_id % 3 WHEN 0 THEN '1:5' WHEN 1 THEN concat('1:', CAST(ent_id % 10 + 1 AS STRING), '00') ELSE '1:50' END AS text FROM {ent} WHERE floor(ent_id / 100) % 2 = 1""",
    "floor_area": """SELECT p_partkey % 50 AS building, CAST(p_size AS BIGINT) AS floor, CAST(max(floor(p_retailprice)) AS DOUBLE) AS area
        FROM {part} WHERE p_size % 4 <> 0 GROUP BY p_partkey % 50, p_size""",
    # Floor plans: a strip of a drawing for each part, its title in one piece or in three, its area in, beside or far below an area text.
    "strip": """SELECT *, CAST(floor(p_partkey / 50) AS BIGINT) * 2000 AS x, 5000 + CAST(floor(p_partkey / 50) AS BIGINT) * 30 AS y, concat(CAST(CAST(floor(p_retailprice) AS BIGINT) AS STRING), '.5') AS area
        FROM {part} WHERE p_size % 4 <> 0""",
    "plan": f"""SELECT p_partkey % 50 AS drawing_id, p_partkey * 10 AS ent_id, {numeral("p_size")} AS text, x AS minx, y AS miny, x + 30 AS maxx, y + 10 AS maxy FROM {{strip}} WHERE p_size % 5 = 0
        UNION ALL SELECT p_partkey % 50, p_partkey * 10 + 1, '~', x + 30, y, x + 40, y + 10 FROM {{strip}} WHERE p_size % 5 = 0
        UNION ALL SELECT p_partkey % 50, p_partkey * 10 + 2, concat({numeral("(p_size + 2)")}, '层平面图'), x + 40, y, x + 100, y + 10 FROM {{strip}} WHERE p_size % 5 = 0
        UNION ALL SELECT p_partkey % 50, p_partkey * 10, concat({numeral("p_size")}, '层平面图'), x, y, x + 100, y + 10 FROM {{strip}} WHERE p_size % 5 <> 0
        UNION ALL SELECT p_partkey % 50, p_partkey * 10 + 3, CASE p_partkey % 3 WHEN 0 THEN concat('本层建筑面积：', area, ' M') WHEN 1 THEN '本层建筑面积' ELSE '层建筑面积' END, x + 20, y - 100, x + 120, y - 90 FROM {{strip}}
        UNION ALL SELECT p_partkey % 50, p_partkey * 10 + 4, ':', x + 130, y - 99, x + 135, y - 91 FROM {{strip}} WHERE p_partkey % 3 = 1
        UNION ALL SELECT p_partkey % 50, p_partkey * 10 + 5, CASE WHEN p_partkey % 3 = 1 THEN concat(area, ' M') ELSE area END, CASE WHEN p_partkey % 3 = 1 THEN x + 150 ELSE x + 40 END, CASE WHEN p_partkey % 3 = 1 THEN y - 98 ELSE y - 3500 END,
            x + 200, CASE WHEN p_partkey % 3 = 1 THEN y - 92 ELSE y - 3490 END FROM {{strip}} WHERE p_partkey % 3 <> 0
        UNION ALL SELECT p_partkey % 50, p_partkey * 10 + 6, 'other 7', x + 400, y - 98, x + 450, y - 92 FROM {{strip}} WHERE p_partkey % 3 = 1""",
    "task_log": """SELECT user_id AS task_id, ts, value,
        CASE event_type WHEN 'signup' THEN 'START' WHEN 'purchase' THEN 'FINISH' WHEN 'error' THEN 'FAIL' ELSE 'PROGRESS' END AS kind
        FROM {events}""",
    # The fixed tables of the field specs.
    "spec_key": values(S.KEYS, "field, key_no, key"),
    "spec_scope": values(S.SCOPES, "field, scope_no, scope"),
    "spec_title": values(S.TITLES, "field, title_no, title_key"),
    "spec_class": values(S.CLASSES + _TYPES, "field, class_no, class, label"),
    "spec_default": values(S.DEFAULTS, "field, fallback"),
    # Files of four documents each in scopes of projects.
    "file_doc": f"""SELECT doc_id, text, source, lang, {_FILE} AS file_id, concat('p', CAST({_FILE} % 61 AS STRING)) AS project,
        CASE {_FILE} % 7 WHEN 0 THEN 'TENDER' WHEN 1 THEN 'BUILDING_DESIGN' WHEN 2 THEN 'BASEMENT' WHEN 3 THEN 'DEFENSE' WHEN 4 THEN 'CCD'
            WHEN 5 THEN 'BUILDING' ELSE 'STRUCTURE' END AS scope FROM {{documents}}""",
    # Tables and texts of these files: whole documents in whose texts frequent words are keys and classes of the specs.
    "block": f"""SELECT doc_id AS block_id, file_id, project, scope, CASE WHEN doc_id % 3 = 0 THEN 'table' ELSE 'text' END AS kind,
        replace(replace(replace(replace(text, ' of ', concat(' ', a.key, '：')), ' de ', concat('，', b.key)), ' und ', b.key), ' in ',
            CASE WHEN doc_id % 4 = 1 THEN concat(' ', c.class, ' ') ELSE ' in ' END) AS text
        FROM {{file_doc}} JOIN {{spec_key}} a ON a.no = doc_id % {len(S.KEYS)} JOIN {{spec_key}} b ON b.no = (doc_id * 7 + 3) % {len(S.KEYS)}
        JOIN {{spec_class}} c ON c.no = doc_id % {len(S.CLASSES + _TYPES)}""",
    # Titled paragraphs of every eighth document, the second one under a title without key.
    "paragraph": f"""SELECT doc_id AS block_id, file_id, project, scope, 0 AS seq, concat('第', CAST(doc_id % 9 AS STRING), '章 ', title_key, '说明') AS title,
            concat(text, ' ', class) AS content FROM {{file_doc}} JOIN {{spec_title}} t ON t.no = doc_id % {len(S.TITLES)} JOIN {{spec_class}} c ON c.no = (doc_id * 5) % {len(S.CLASSES + _TYPES)}
            WHERE doc_id % 8 = 3 AND text IS NOT NULL AND NOT contains(text, '**')
        UNION ALL SELECT doc_id, file_id, project, scope, 1, concat('附录 ', source), lang FROM {{file_doc}} WHERE doc_id % 8 = 3 AND text IS NOT NULL AND NOT contains(text, '**')""",
    # The texts of blocks in drawing boxes.
    "drawn": """SELECT drawing_id, ent_id, minx, miny, maxx, maxy, block_id, file_id, project, scope,
        substr(text, CAST(floor(length(text) * (part - 1) / parts) AS INT) + 1,
            CAST(floor(length(text) * part / parts) AS INT) - CAST(floor(length(text) * (part - 1) / parts) AS INT)) AS text
        FROM {share} JOIN {block} ON block_id = doc_id""",
    # Provinces, cities and counties; names lie within and across each other.
    "place": """SELECT r_name AS place, 0 AS level, CAST(NULL AS STRING) AS city, r_name AS province FROM {region}
        UNION ALL SELECT n_name, 1, n_name, r_name FROM {nation} JOIN {region} ON r_regionkey = n_regionkey
        UNION ALL SELECT concat(n_name, '_', CAST(s_suppkey % 3 AS STRING)), 2, n_name, r_name FROM {supplier} JOIN {nation} ON n_nationkey = s_nationkey JOIN {region} ON r_regionkey = n_regionkey
            GROUP BY n_name, s_suppkey % 3, r_name
        UNION ALL SELECT concat(r_name, ' ', n_name), 2, n_name, r_name FROM {nation} JOIN {region} ON r_regionkey = n_regionkey WHERE n_nationkey % 5 = 0
        UNION ALL SELECT 'OLD TOWN', 2, n_name, r_name FROM {nation} JOIN {region} ON r_regionkey = n_regionkey WHERE n_nationkey % 6 = 1""",
    "address": """SELECT c_custkey, concat('at ', c_name, ' in ', CASE c_custkey % 5 WHEN 0 THEN 'OLD TOWN near ' WHEN 1 THEN concat(r_name, ' ') ELSE '' END,
        n_name, CASE c_custkey % 4 WHEN 0 THEN '_1' WHEN 1 THEN '_7' WHEN 2 THEN concat(', ', r_name) ELSE '0' END, ' no. ', CAST(c_custkey % 90 AS STRING)) AS address
        FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey JOIN {region} ON r_regionkey = n_regionkey WHERE c_custkey % 11 <> 0
        UNION ALL SELECT c_custkey, concat('post box ', c_name) FROM {customer} WHERE c_custkey % 11 = 0""",
    "tree": """SELECT concat('r', r_regionkey) AS id, CAST(NULL AS STRING) AS parent, r_name AS name, 'D' AS kind, CAST(0 AS BIGINT) AS size FROM {region}
        UNION ALL SELECT concat('n', n_nationkey), concat('r', n_regionkey), n_name, 'D', CAST(0 AS BIGINT) FROM {nation}
        UNION ALL SELECT concat('c', c_custkey), concat('n', c_nationkey), c_name, 'F', CAST(c_custkey % 97 AS BIGINT) FROM {customer}""",
}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table or one derived from them."""
    if name not in TEXTS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = TEXTS[name]
    return spark.sql(text, **{n: frame(spark, sf_dir, n) for n in dict.fromkeys(_NAME.findall(text))})


def duck(text: str) -> str:
    """The query for DuckDB: tables in braces become given tables or common table expressions."""
    order: list[str] = []

    def need(t: str) -> None:
        for n in _NAME.findall(t):
            if n in TEXTS and n not in order:
                need(TEXTS[n])
                order.append(n)

    need(text)
    plain = lambda t: _NAME.sub(r"\1", t).replace("AS STRING)", "AS VARCHAR)")
    ctes = [f"{n} AS ({plain(TEXTS[n])})" for n in order]
    body = plain(text).strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ", ".join([*ctes, body[14:].strip()])
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join([*ctes, body[5:].strip()])
    return ("WITH " + ", ".join(ctes) + " " if ctes else "") + body
