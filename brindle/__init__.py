"""Spark-native analytics for tabular data and large text corpora."""

import sys

from pyspark import cloudpickle

# Python workers get the package's functions by value: it need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
