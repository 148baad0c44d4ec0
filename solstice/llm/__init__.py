"""Operators for training-data pipelines; nothing else in the package imports this."""

import sys

from pyspark import cloudpickle

# Executors receive the functions by value and need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
