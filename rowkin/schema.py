"""Fixed schemas of the tables the engine reads and writes; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType(), True) for n in names])


SOURCE = _strings("entity_id", "business_name", "business_address", "country")
TRUTH = _strings("source1_entity_id", "matched_entity_ids")
PAIRS = _strings("source1_entity_id", "other_id")
