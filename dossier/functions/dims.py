"""Fixed dimension tables. They hold contract values, so they are plain literals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# fixed values: the card fields in display order
CARD_FIELDS = (
    "pump_type",
    "tag_no",
    "fluid_name",
    "density",
    "viscosity",
    "fluid_temperature",
    "environment_temperature",
    "others",
    "process_capacity",
    "rated_capacity",
    "suction_pressure",
    "discharge_pressure",
    "wetted_parts_material",
)
# fixed values: further parameters that share the field "others", in order
OTHER_PARAMETERS = (
    "ab_group_note",
    "service_name",
    "installation",
    "quantity",
    "operating",
    "spare",
    "operation_mode",
    "suction_from",
    "discharge_to",
    "driver",
    "npsha",
    "capacity_control_mode",
    "pulsation_damper",
    "mechanical_seal_type",
    "design_standard",
    "design_suction_pressure",
    "design_temperature",
)
# fixed values: labels of a field in translations
TRANSLATED_LABELS = {
    "pump_type": ("泵类型", "设备类型"),
    "service_name": ("用途", "服务", "工艺用途"),
    "fluid_name": ("介质名称", "介质", "输送介质"),
    "wetted_parts_material": ("过流部件材质", "接液部件材质", "材质"),
}
# fixed values: further parameters that take a translation, with their label
TRANSLATABLE_OTHERS = {
    "service_name": "用途",
    "installation": "安装位置",
    "operation_mode": "运行方式",
    "suction_from": "入口来源",
    "discharge_to": "出口去向",
    "driver": "驱动方式",
    "capacity_control_mode": "流量控制",
    "pulsation_damper": "脉动抑制",
    "mechanical_seal_type": "机械密封",
}
# fixed values: states of a field
MISSING, EXTRACTED, CONFLICT, LOW_CONFIDENCE = "原文件未提供", "已提取", "冲突待确认", "低置信度待复核"
# fixed values: precedence of stage states, worst last
STATUS_ORDER = ("success", "partial_success", "blocked", "failed")

FLOW_FIELDS = ("process_capacity", "rated_capacity")
PRESSURE_FIELDS = ("suction_pressure", "discharge_pressure")


def field_of(name: str) -> str:
    """The card field of a parameter."""
    if name == "material":
        return "wetted_parts_material"
    return name if name in CARD_FIELDS else "others"


def fields_table(spark: SparkSession) -> DataFrame:
    """(field_ord, field): 13 rows."""
    return spark.createDataFrame(list(enumerate(CARD_FIELDS)), "field_ord int, field string")
