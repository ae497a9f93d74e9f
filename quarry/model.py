"""Records of the supplier directory, and enumerations whose order carries meaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The order is the sort order.
LOCATION_TYPES = ["HEADQUARTERS", "BRANCH", "PLANT", "WAREHOUSE", "OFFICE"]
#: Contact types from the most to the least wanted for a quote request.
RFQ_CONTACT_TYPES = ["PROCUREMENT", "ESTIMATING", "SALES", "GENERAL", "INDIVIDUAL_BUSINESS_CONTACT", "OTHER"]

CLAIM = T.StructType(
    [
        T.StructField(name, kind)
        for name, kind in [
            ("claim_id", T.StringType()),
            ("supplier_id", T.StringType()),
            ("doc_id", T.StringType()),
            ("claim_type", T.StringType()),
            ("raw_value", T.StringType()),
            ("normalized_value", T.StringType()),
            ("evidence_text", T.StringType()),
            ("evidence_locator", T.StringType()),
            ("extraction_method", T.StringType()),
            ("confidence", T.DoubleType()),
            ("review_state", T.StringType()),
            ("source_url", T.StringType()),
            ("page_type", T.StringType()),
            ("page_text", T.StringType()),
            ("seq", T.LongType()),
        ]
    ]
)


def rank_in(value: Column, order: list[str]) -> Column:
    """Place of value in a declared order from 1; values outside come last."""
    at = F.array_position(F.array(*map(F.lit, order)), value)
    return F.when(at > 0, at).otherwise(F.lit(len(order) + 1))
