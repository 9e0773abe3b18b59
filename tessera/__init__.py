"""Analytics for content-addressed, versioned data on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions for executors carry their code along, so that workers need not find this package by a path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
