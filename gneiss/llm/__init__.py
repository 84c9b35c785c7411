"""Operators of a training-data pipeline, and the queries that apply them."""

import sys

from pyspark import cloudpickle

# Functions of this package reach the executors by value, whether or not they can import it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
