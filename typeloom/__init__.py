"""typeloom: typing of part master data and extraction of dimensions, as Spark plans."""

from .functions.units import length_mm, metric_record, raw_dimensions, triple_mm, weight_g
from .operators.hybrid import HybridClassifier, Settings
from .operators.readers import Reader, process, read_sheets
from .sources.providers import Cached, PageTable, Provider, Samples, Search, cascade

__version__ = "0.1.0"
__all__ = [
    "Cached", "HybridClassifier", "PageTable", "Provider", "Reader", "Samples", "Search", "Settings", "cascade",
    "length_mm", "metric_record", "process", "raw_dimensions", "read_sheets", "triple_mm", "weight_g",
]
