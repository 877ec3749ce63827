"""Spark-native analytics over collections of documents, pages and positioned text."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors with the task: nothing need be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
