"""Bookkeeping imports on Spark: clean, map, check, match, balance and emit accounting data."""

import sys

from pyspark import cloudpickle

# Functions that run in Python tasks travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
