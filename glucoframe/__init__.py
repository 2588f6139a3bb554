"""glucoframe: cohort-scale insulin and glucagon indices as Spark DataFrame operations."""

from glucoframe.settings import (
    BELFIORE_MEANS,
    PUBLISHED_AVIGNON_WEIGHT,
    AvignonWeight,
    BelfioreMeans,
    ConversionSettings,
    UnitChoice,
)

__version__ = "0.1.0"

__all__ = [
    "AvignonWeight",
    "BELFIORE_MEANS",
    "BelfioreMeans",
    "ConversionSettings",
    "PUBLISHED_AVIGNON_WEIGHT",
    "UnitChoice",
]
