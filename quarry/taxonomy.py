"""The dictionary of capabilities: names with their slugs, and other names for them (fixed values)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CAPABILITIES = {
    "structural-steel-fabrication": "Structural Steel Fabrication",
    "custom-metal-fabrication": "Custom Metal Fabrication",
    "stainless-steel-fabrication": "Stainless Steel Fabrication",
    "welding": "Welding",
    "machining": "Machining",
    "pipe-fabrication": "Pipe Fabrication",
    "electrical-contracting": "Electrical Contracting",
    "industrial-automation-controls": "Industrial Automation & Controls",
    "millwrighting-mechanical-maintenance": "Millwrighting & Mechanical Maintenance",
    "mechanical-hvac": "Mechanical/HVAC",
    "pressure-vessels-tank-fabrication": "Pressure Vessels & Tank Fabrication",
    "protective-coatings-industrial-painting": "Protective Coatings & Industrial Painting",
    "hydraulic-repair-fluid-power": "Hydraulic Repair & Fluid Power",
    "ndt-industrial-inspection": "NDT & Industrial Inspection",
    "heavy-civil-industrial-construction": "Heavy Civil & Industrial Construction",
}
ALIASES = {
    "structural-steel-fabrication": ["Structural Steel", "Steel Fabrication", "Building Frames", "Bridge Steel", "Heavy Steel", "Steel Erection"],
    "custom-metal-fabrication": ["Metal Fabrication", "Custom Fabrication", "Custom Metalwork", "Sheet Metal Fabrication", "Industrial Fabrication"],
    "stainless-steel-fabrication": ["Sanitary Stainless"],
    "welding": ["TIG Welding", "MIG Welding", "CWB Certified Welding", "Pressure Welding"],
    "machining": ["CNC Machining", "Precision Machining", "Machine Shop", "Grinding and Machining", "Grinding & Machining"],
    "pipe-fabrication": ["Pipe Fitting", "Pipefitting", "Process Piping"],
    "electrical-contracting": ["Industrial Electrical", "Electrical Contractor", "Commercial Electrical", "Electrical Wiring", "Electric Services", "Electrical Contracting", "High Voltage", "Electricians"],
    "industrial-automation-controls": ["Industrial Automation", "Control Panels", "Control Panel", "PLC Programming", "Automation Systems", "SCADA Systems", "Machine Automation"],
    "millwrighting-mechanical-maintenance": ["Millwrighting", "Millwright", "Machinery Installation", "Equipment Installation", "Shutdown Maintenance", "Mechanical Maintenance"],
    "mechanical-hvac": ["Commercial HVAC", "Industrial HVAC", "Ventilation", "Mechanical Contractor", "Mechanical Contracting", "HVAC"],
    "pressure-vessels-tank-fabrication": ["Pressure Vessels", "Pressure Vessel", "Tank Fabrication"],
    "protective-coatings-industrial-painting": ["Protective Coatings", "Industrial Coatings", "Hardchrome Plating", "Chrome Plating", "Industrial Painting", "Powder Coating", "Sandblasting"],
    "hydraulic-repair-fluid-power": ["Hydraulic Repair", "Hydraulics", "Fluid Power"],
    "ndt-industrial-inspection": ["Non-Destructive Testing", "NDT Inspection", "Ultrasonic Testing", "NDT"],
    "heavy-civil-industrial-construction": ["Heavy Civil Construction", "Civil Engineering", "Excavation", "Site Preparation", "Quarry and Crushing", "Drilling & Blasting"],
}


def phrases() -> list[tuple[str, str, bool]]:
    """(slug, phrase, is_alias) of every name."""
    return [(slug, name, False) for slug, name in CAPABILITIES.items()] + [(slug, alias, True) for slug, names in ALIASES.items() for alias in names]


def tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(slug, name) and (alias, slug)."""
    return spark.createDataFrame([*CAPABILITIES.items()], "slug string, name string"), spark.createDataFrame([(a, s) for s, names in ALIASES.items() for a in names], "alias string, slug string")


def with_static_terms(stored: DataFrame) -> DataFrame:
    """stored terms (slug, phrase, is_alias), and the fixed ones whose phrase no stored term has, without regard to case."""
    from pyspark.sql import functions as F

    fixed = stored.sparkSession.createDataFrame(phrases(), "slug string, phrase string, is_alias boolean").withColumn("_low", F.lower("phrase"))
    missing = fixed.join(stored.select(F.lower("phrase").alias("_low")).distinct(), "_low", "left_anti").drop("_low")
    return stored.select("slug", "phrase", "is_alias").unionByName(missing)
