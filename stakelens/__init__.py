"""Staking-concentration and governance-participation metrics on Spark.

Every metric takes a :class:`~stakelens.sources.tables.ChainTables` (one
DataFrame per input table) and a :class:`~stakelens.spec.ChainSpec` (what
differs between networks) and returns a lazy DataFrame.
"""

from stakelens.sources.tables import ChainTables
from stakelens.spec import AXELAR, AXELAR_AS_PUBLISHED, COSMOS, OSMOSIS, PRESETS, TERRA, ChainSpec

__all__ = [
    "AXELAR",
    "AXELAR_AS_PUBLISHED",
    "COSMOS",
    "OSMOSIS",
    "PRESETS",
    "TERRA",
    "ChainSpec",
    "ChainTables",
]
