"""Forensic and compliance analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Pandas kernels travel to the executors by value, so workers need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
