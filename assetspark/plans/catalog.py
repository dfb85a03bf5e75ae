"""All registries, in the order of the inventory."""

from pyspark.sql import DataFrame, SparkSession

from .consensus_queries import CONSENSUS
from .derive_queries import DERIVE
from .gate_queries import GATES
from .graph_queries import GRAPH
from .selection_queries import SELECTION, summary
from .adapters import Tables
from .source_queries import SOURCES
from .texel_queries import TEXELS
from .text_queries import TEXT

ALL = [TEXT, SELECTION, CONSENSUS, GRAPH, TEXELS, DERIVE, GATES, SOURCES]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run summary: discovery counts, tiers and processing states."""
    return summary(Tables(spark, sf_dir))
