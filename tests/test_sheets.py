"""Data sheet pages, one line or many, against what the sheets say."""

from dossier.operators import sheets

API = (
    "CONTROLLED VOLUME PUMP DATA SHEET API 675 ITEM NO. PK00000 PUMP ITEM NO'S P00000A/B NO. OF PUMPS REQUIRED TWO (2) SERVICE Chemical Injection MODEL MX-1 "
    "SIZE AND TYPE Hydraulic Diaphragm MANUFACTURER Example CAPACITY @ PT (l/hr): MAXIMUM 100 MINIMUM 10 NORMAL 80 SUCTION PRESSURE (BARG): MAXIMUM 1.0 DISCHARGE PRESSURE (BARG): MAXIMUM 6.0 "
    "SPECIFIC GRAVITY MAX 1.05 MIN 1.00 VISCOSITY (cP) 4.5 PUMPING TEMPERATURE (C): NORMAL 35 MAX 60 MIN 10 RATED CAPACITY (l/hr) 90 RANGE OF AMBIENT TEMPS: MIN/MAX -5 / 45 °C OPERATING CONDITIONS"
)
STUFF = "CONTROLLED VOLUME PUMP DATA SHEET API 675 ITEM NO. PK00000 MATERIALS LIQUID END SS316L PROCESS DIAPHRAGM PTFE VALVE BODY SS316L FRAME Carbon Steel"
PUMP = (
    "DATA SHEET Centrifugal Pump ITEM NUMBER 0-P-000ABC SERVICE Cooling Water Pumps CASE 1 FLUID TYPE Treated Water MODEL CP-100 SPECIFIC GRAVITY @ P&T 1.02 COOLING WATER "
    "VISCOSITY @ P&T cP 1.5 SEAL FLUSH CAPACITY (for each pump) m3/hr 25.0 FURNISHED BY SUCTION PRESSURE (kg/cm2)g 1.0 DISCH PRESSURE (kg/cm2)g 6.0 "
    "NORM/MIN/MAX TEMP 40 / 20 / 60 C MAX HEAD PUMP TYPE Horizontal Surface Pump SKID PIPE MATERIAL Carbon Steel TYPE"
)
MULTI = (
    "Process Datasheet for Chemical Injection Pump (Unit) GENERAL DATA Tag No.: Z00-SYN-0000-P0 A/B Description: Chemical Injection Pump 1 Fluid Name / State: Inhibitor / Liquid Quantity: 2 "
    "Service: Chemical Injection Type: Metering Pump 2 OPERATING DATA Operating Temperature (oC) 35 3 Operating Pressure (barg) 2.0 4 Liquid Density (Kg/m3) 950 5 Liquid Viscosity (cP) 12 "
    "6 DESIGN DATA Flow Rate (lit/hr) 40 7 Design Pressure / PSV Set Pressure (barg) 8 Design Temperature (oC) 70 8 Vapour Pressure 0.1 Suction / Discharge Pressure (barg) 1.0 / 6.0 9 ELECTRICAL DATA "
    "Material SS316L 10 Differential Pressure 5.0"
)
SAID = {
    "P00000A/B": {
        "tag_no": "P00000A/B", "quantity": "2", "fluid_name": "SERVICE Chemical Injection", "pump_type": "Hydraulic Diaphragm, API 675", "process_capacity": "80 l/hr", "suction_pressure": "1.0 bar.g", "discharge_pressure": "6.0 bar.g",
        "density": "SG=1.05", "viscosity": "4.5 cP", "fluid_temperature": "35", "rated_capacity": "90 l/hr", "environment_temperature": "-5-45 ℃", "wetted_parts_material": "Liquid End: SS316L; Process Diaphragm: PTFE; Valve Body: SS316L",
    },
    "0-P-000A/B/C": {
        "tag_no": "0-P-000A/B/C", "service_name": "Cooling Water Pumps", "fluid_name": "Treated Water", "density": "1.02", "viscosity": "1.5 cP", "process_capacity": "25.0 m3/hr", "suction_pressure": "1.0 (kg/cm2)g",
        "discharge_pressure": "6.0 (kg/cm2)g", "fluid_temperature": "40 / 20 / 60 ℃", "pump_type": "Centrifugal Pump; Horizontal Surface Pump", "wetted_parts_material": "Pipe Material: Carbon Steel",
    },
    "Z00-SYN-0000-P0 A/B": {
        "tag_no": "Z00-SYN-0000-P0 A/B", "pump_type": "Chemical Injection; Metering Pump", "fluid_name": "Inhibitor / Liquid", "quantity": "2", "fluid_temperature": "35 ℃", "density": "950 kg/m3", "viscosity": "12 cP",
        "process_capacity": "40 lit/hr", "design_temperature": "70 ℃", "suction_pressure": "1.0 bar.g", "discharge_pressure": "6.0 bar.g", "wetted_parts_material": "SS316L",
    },
}
LINES = "file string, page long, line long, text string"


def whole(*pages):
    return [(f, p, 1, t) for f, p, t in pages]


def wrapped(*pages):
    """Lines broken after labels and within values."""
    out = []
    for f, p, t in pages:
        broken = t.replace("SERVICE ", "SERVICE\n").replace("Diaphragm", "\nDiaphragm").replace("MAXIMUM", "\nMAXIMUM").replace("Water", "\nWater").replace("Type:", "Type:\n").replace(" 1.02", "\n1.02\n")
        out += [(f, p, k, x) for k, x in enumerate(broken.split("\n"))]
    return out


def told(spark, lines):
    got = {}
    for r in sheets.cards(spark.createDataFrame(lines, LINES)).collect():
        assert r.name not in got.setdefault(r.tag, {})
        got[r.tag][r.name] = f"{r.value} {r.unit}".strip()
    return got


def test_sheets_of_every_kind(spark):
    pages = ("a.pdf", 1, API), ("a.pdf", 2, STUFF), ("b.pdf", 1, PUMP), ("c.pdf", 2, MULTI), ("d.pdf", 1, "a letter about pumps, MODEL 3")
    assert told(spark, whole(*pages)) == SAID
    assert told(spark, wrapped(*pages)) == SAID


def test_materials_by_item_by_page_or_not_at_all(spark):
    lines = whole(
        ("a", 1, API), ("z", 9, STUFF),
        ("b", 4, API.replace("PK00000", "PK11111").replace("P00000", "P11111")), ("b", 5, STUFF.replace("ITEM NO. PK00000 ", "").replace("PTFE", "FKM")),
        ("c", 1, API.replace("PK00000", "PK22222").replace("P00000A", "P22222A").replace("NORMAL 80", "NORMAL")), ("c", 3, STUFF.replace("PK00000", "PK33333")),
    )
    got = {(r.tag, r.name): r for r in sheets.cards(spark.createDataFrame(lines, LINES)).collect()}
    assert "PTFE" in got["P00000A/B", "wetted_parts_material"].value and "FKM" in got["P11111A/B", "wetted_parts_material"].value
    lost = got["P22222A/B", "wetted_parts_material"]
    assert (lost.value, lost.note) == ("", "api675_material_page_not_matched")
    full = got["P22222A/B", "process_capacity"]
    assert (full.value, full.unit, full.note) == ("100", "l/hr", "api675_normal_capacity_missing")


def test_no_page_and_ways_to_write_a_pair(spark):
    assert told(spark, []) == {}
    from pyspark.sql import functions as F

    rows = [("P1234A/B",), ("p 1234 A , B",), ("P1234A, P1234B",), ("P1234AB",), ("P12A/B",), ("Z00-SYN-0000-P0A,B",), ("9-P-12 AB",)]
    got = spark.createDataFrame(rows, "t string").select(sheets.api_tag(F.col("t")), sheets.multisource_tag(F.col("t")), sheets.centrifugal_tag(F.col("t"))).collect()
    assert [r[0] for r in got] == ["P1234A/B"] * 4 + [None] * 3
    assert [r[1] for r in got] == [None] * 5 + ["Z00-SYN-0000-P0 A/B", None]
    assert got[6][2] == "9-P-12A/B"


def test_item_numbers_of_long_order_numbers(spark, tmp_path):
    """Orders with equal first six digits keep materials of their own."""
    from dossier.plans import sheet_queries

    keys = [12000000, 12000006, 12000012]
    make = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    make("orders", [(k, 2, "1-URGENT") for k in keys], "o_orderkey long, o_custkey long, o_orderpriority string")
    make("part", [(i, "pump name", f"KIND {i}", f"Brand#{i}") for i in range(3)], "p_partkey long, p_name string, p_type string, p_brand string")
    make("lineitem", [(k, i, 1, 5.0, 0.01, 0.02) for i, k in enumerate(keys)], "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double")
    got = {r.page: r.value for r in sheet_queries.sheet_cards(spark, str(tmp_path)).where("name = 'wetted_parts_material'").collect()}
    assert got == {2 * k: f"Liquid End: Brand#{i}; Process Diaphragm: KIND {i}" for i, k in enumerate(keys)}
