"""The queries of the operators and the SQL that gives the same rows."""

from __future__ import annotations

from quarry.llm.clustering import OP12_SQL, op12_clustering
from quarry.llm.decontamination import OP9_SQL, op9_decontamination
from quarry.llm.filters import OP11_SQL, op11_filters
from quarry.llm.fingerprints import op13_fingerprints
from quarry.llm.jaccard import OP10_SQL, op10_jaccard
from quarry.llm.licenses import OP5_SQL, op5_licenses
from quarry.llm.media import op8_media
from quarry.llm.mixing import OP7_SQL, op7_mixing
from quarry.llm.secrets import op4_secrets
from quarry.llm.sharding import op1_sharding
from quarry.llm.suffix import op6_suffix
from quarry.llm.toxicity import op2_toxicity
from quarry.llm.urls import op3_urls

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_toxicity": op2_toxicity,
    "op3_urls": op3_urls,
    "op4_secrets": op4_secrets,
    "op5_licenses": op5_licenses,
    "op6_suffix": op6_suffix,
    "op7_mixing": op7_mixing,
    "op8_media": op8_media,
    "op9_decontamination": op9_decontamination,
    "op10_jaccard": op10_jaccard,
    "op11_filters": op11_filters,
    "op12_clustering": op12_clustering,
    "op13_fingerprints": op13_fingerprints,
}

ORACLES = {
    "op5_licenses": OP5_SQL,
    "op7_mixing": OP7_SQL,
    "op9_decontamination": OP9_SQL,
    "op10_jaccard": OP10_SQL,
    "op11_filters": OP11_SQL,
    "op12_clustering": OP12_SQL,
}
