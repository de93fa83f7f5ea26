"""The project fields: fixed values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Name, id, scopes, aliases, paragraph titles, fields it is derived from, default.
FIELDS = [
    ("项目名称", "project_name", ["TENDER"], ["标段名称", "工程名称"], ["投标须知前附表", "OLE"], [], "暂无项目名称"),
    ("建设性质", "construction_nature", ["TENDER"], [], ["工程概况", "OLE"], [], "新建"),
    ("项目地点", "project_location", ["TENDER"], ["工程地点", "联系地址", "地址："], ["投标须知前附表", "OLE"], [], "暂无项目地点"),
    ("建设地点等级", "construction_location_level", [], [], [], ["项目地点"], "未知"),
    ("一级项目类别", "primary_project_category", ["TENDER"], [], ["工程概况", "OLE"], [], "未知"),
    ("总建筑面积", "total_building_area", ["TENDER", "BUILDING_DESIGN"], [], ["工程概况", "技术经济指标", "OLE"], ["地上建筑面积", "地下建筑面积"], "-1"),
    ("地上建筑面积", "above_ground_building_area", ["TENDER", "BUILDING_DESIGN"], ["地上总建筑面积"], ["工程概况", "技术经济指标", "OLE"], ["建筑面积"], "-1"),
    ("地下建筑面积", "underground_building_area", ["TENDER", "BUILDING_DESIGN"], ["地下总建筑面积", "地下室总面积"], ["工程概况", "技术经济指标", "OLE"], ["建筑面积"], "-1"),
    ("占地面积", "land_area", ["TENDER", "BUILDING_DESIGN"], ["工程建设用地面积", "总用地面积", "建设用地面积", "用地面积"], ["工程概况", "OLE"], [], "-1"),
    ("容积率", "plot_ratio", ["BUILDING_DESIGN"], ["规定容积率"], ["技术经济指标", "OLE"], [], "-1"),
    ("学位数", "degree_count", ["TENDER"], ["学位个数", "学位"], [], [], "-1"),
    ("住宅总户数", "total_households", ["TENDER", "BUILDING_DESIGN"], ["户数"], [], [], "-1"),
    ("床位数", "bed_count", ["TENDER"], [], [], [], "-1"),
    ("客房数", "room_count", ["BUILDING_DESIGN"], ["总客房数"], ["技术经济指标"], [], "-1"),
    ("投资类型", "investment_type", ["TENDER"], ["资金来源"], ["投标须知前附表", "工程概况"], [], "政府投资"),
    ("造价阶段", "cost_stage", ["TENDER"], [], [], [], "招标阶段"),
    ("执行清单", "execution_list", ["TENDER"], ["工程量的确定方法"], [], [], "GB50500-2008《建设工程工程量清单计价规范》"),
    ("建筑物基底面积", "building_base_area", ["BUILDING_DESIGN"], ["建筑物基底", "建筑基底面积"], ["技术经济指标", "OLE"], [], "-1"),
    ("景观面积", "landscape_area", [], [], [], ["占地面积", "建筑物基底面积"], "-1"),
    ("绿化面积", "greening_area", ["BUILDING_DESIGN"], ["绿地面积"], ["技术经济指标", "OLE"], [], "0"),
    ("绿化率", "greening_rate", ["BUILDING_DESIGN"], [], [], ["绿化面积", "占地面积"], "-1"),
    ("电梯", "elevator", ["CCD"], [], [], [], "-1"),
    ("充电桩停车位", "charger_parking_spaces", ["TENDER", "BUILDING_DESIGN", "BASEMENT"], ["充电桩车位", "充电车位", "充电桩"], ["工程概况", "技术经济指标", "OLE"], [], "-1"),
    ("总停车位", "total_parking_spaces", ["TENDER", "BASEMENT", "BUILDING_DESIGN"], ["停车位", "机动车停车位", "停车数量"], ["工程概况", "技术经济指标", "OLE"], [], "-1"),
    ("开工日期", "start_date", ["TENDER"], ["计划开工日期", "计划开工时间", "正式开工"], [], [], None),
    ("竣工日期", "completion_date", ["TENDER"], ["计划竣工日期", "计划竣工时间", "计划完工日期", "竣工验收"], [], [], None),
    ("工期", "construction_period", [], [], [], ["开工日期", "竣工日期"], "-1"),
    ("基础类型", "foundation_type", ["TENDER"], [], [], [], "桩基础"),
    ("建设单位", "construction_unit", ["TENDER", "BUILDING_DESIGN"], ["招 标 人"], [], [], "暂无建设单位"),
    ("设计单位", "design_unit", ["BUILDING_DESIGN"], ["设计有限公司", "设计股份有限公司", "科技发展有限公司", "设计研究总院", "设计研究院", "设计研究有限公司", "ARCHITECTURAL ARTISTIC DESIGN"], [], [], "暂无设计单位"),
    ("人防建筑面积", "civil_defense_building_area", ["DEFENSE", "BUILDING_DESIGN"], ["人防总建筑面积"], [], [], "-1"),
    ("抗震等级", "earthquake_level", [], [], [], ["业态抗震等级"], "一级"),
    ("建筑面积", "building_area", [], [], [], [], "-1"),
    ("建筑高度", "building_height", [], [], [], [], None),
    ("标准层高", "standard_floor_height", [], [], [], [], "-1"),
    ("楼层数", "number_of_floors", [], ["建筑层数"], [], ["建筑面积"], "-1"),
    ("结构类型", "structure_type", ["TENDER", "BUILDING_DESIGN"], ["主要结构形式"], ["结构设计等级", "结构类型、设计分类等级", "OLE"], [], "框架剪力墙结构"),
    ("使用年限", "service_life", ["TENDER", "BUILDING_DESIGN"], ["设计使用年限"], ["工程概况", "技术经济指标", "OLE"], [], "50"),
    ("业态抗震等级", "business_earthquake_level", ["TENDER", "BUILDING_DESIGN"], ["抗震等级", "结构安全等级", "结构的安全等级", "安全等级划分"], ["工程概况", "结构设计等级", "建筑分类等级", "结构类型、设计分类等级", "OLE"], [], "一级"),
    ("建筑设防烈度", "building_fortification_intensity", ["TENDER", "BUILDING_DESIGN"], ["抗震设防烈度"], ["工程概况", "OLE"], [], "7"),
]

#: Field, its classes in order, synonyms, suffix.
CATEGORIES = [
    ("construction_nature", ["新建", "改建", "扩建"], {}, ""),
    ("primary_project_category", ["居住建筑", "学校", "办公建筑", "体育建筑", "卫生建筑", "文化建筑", "商业建筑", "旅馆酒店建筑", "交通建筑", "居民服务建筑", "工业建筑", "市政工程", "轨道交通工程"], {"学校": "教育建筑"}, "建筑"),
    ("investment_type", ["政府投资", "企业投资", "个人投资"], {}, ""),
    ("cost_stage", ["估算", "概算", "招标", "预算", "结算", "决算"], {}, "阶段"),
    ("execution_list", ["GB50500-2008《建设工程工程量清单计价规范》", "GB50500-2013《建设工程工程量清单计价规范》", "GB/T50854-2024《房屋建筑与装饰工程工程量计算标准》"], {}, ""),
    ("foundation_type", ["条形基础", "独立基础", "满堂基础", "桩基础", "桩基工程", "桩基"], {"桩基工程": "桩基础", "桩基": "桩基础"}, ""),
]
#: Characters that a prompt holds of the paragraphs and of the windows of a category, and of the evidence of any other field.
CUTS = {"paragraphs": 4096, "windows": 512, "value": 3000}


def class_label(word: str, synonyms: dict[str, str], suffix: str) -> str:
    """A class with its synonym in its place and the suffix set once."""
    return synonyms.get(word, word).removesuffix(suffix) + suffix


#: Each field's name and aliases (field, place, key), scopes (field, place, scope), title keys (field, place, title key), classes (field, place, class, label).
KEYS = [(f[1], n, key) for f in FIELDS for n, key in enumerate([f[0], *f[3]])]
SCOPES = [(f[1], n, scope) for f in FIELDS for n, scope in enumerate(f[2])]
TITLES = [(f[1], n, title) for f in FIELDS for n, title in enumerate(f[4])]
CLASSES = [(field, n, word, class_label(word, synonyms, suffix)) for field, words, synonyms, suffix in CATEGORIES for n, word in enumerate(words)]
DEFAULTS = [(f[1], f[6]) for f in FIELDS]
#: Fields that have a value for each building type.
BUSINESS = ("building_area", "building_height", "standard_floor_height", "number_of_floors", "structure_type", "service_life", "business_earthquake_level", "building_fortification_intensity")

SCHEMA = "name string, field string, scopes array<string>, aliases array<string>, titles array<string>, deps array<string>, default string"


def field_specs(spark: SparkSession) -> DataFrame:
    """One row for each field; it is small and fixed."""
    return spark.createDataFrame(FIELDS, SCHEMA)
