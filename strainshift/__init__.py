"""Variant-frequency and control-index analytics as Spark jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few pandas functions travel with their tasks; executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
