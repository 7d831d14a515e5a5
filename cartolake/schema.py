"""Names and schemas of the catalog tables.

Column descriptions exist only for tables whose description slot is filled;
a failed table has one ``table_descriptions`` row with a NULL description and
no column rows.  A table without any row there is an integrity error.
"""

from __future__ import annotations

TABLE_KEY = ["schema", "table"]
COLUMN_KEY = ["schema", "table", "column"]
EDGE = [
    "source_schema", "source_table", "source_column",
    "target_schema", "target_table", "target_column",
]
SOURCE = EDGE[:3]
TARGET = EDGE[3:]

# Fixed values of the data model.
SEMANTIC_TYPES = ("identifier", "dimension", "measure", "other")
PII_RISKS = ("none", "low", "medium", "high")
PROTECTED_RISKS = ("high", "medium")
BUNDLE_VERSION = 1


# Dataset schemas, as DDL.
COLUMNS = (
    "schema string, `table` string, ordinal int, `column` string, data_type string, "
    "nullable boolean, is_primary_key boolean, `default` string"
)
TABLES = ("schema string, `table` string, row_count bigint")
FOREIGN_KEYS = (", ".join(f"{name} string" for name in EDGE))
RELATIONSHIPS = (", ".join(f"{name} string" for name in [*EDGE, "kind"]))
TABLE_DESCRIPTIONS = (
    "schema string, `table` string, description string, grain string, "
    "domain_hints array<string>, confidence double"
)
COLUMN_DESCRIPTIONS = (
    "schema string, `table` string, `column` string, description string, "
    "semantic_type string, pii_risk string, confidence double"
)
META = ("schema_version int, generated_at string, connector string, database string")
