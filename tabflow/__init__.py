"""tabflow: load tabular files into keyed Spark tables and export them again."""

import sys

from pyspark import cloudpickle

from tabflow.types import LogicalType, Policy

__all__ = ["LogicalType", "Policy"]

# Workers get the few Python task functions by value, so the package need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
