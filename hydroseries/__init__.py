"""Spark-native analytics for irregular sensor time series."""

import sys

from pyspark import cloudpickle

# Functions of the package that run in Python workers travel with the job, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
