"""Spark-native image-based profiling: lazy, distributed DataFrame-in/DataFrame-out verbs."""

from phenolith.operators.aggregate import aggregate
from phenolith.operators.annotate import annotate
from phenolith.operators.consensus import consensus
from phenolith.operators.normalize import normalize
from phenolith.operators.select import feature_select

__all__ = ["aggregate", "annotate", "consensus", "feature_select", "normalize"]
