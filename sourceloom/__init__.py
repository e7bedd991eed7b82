"""Code-corpus analytics as composable Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel by value, so executors need no copy of
# this package and the driver may start in any folder.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
