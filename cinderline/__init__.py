"""Spark-native operators for wildfire-event analytics."""

import sys

from pyspark import cloudpickle

# Functions handed to executors are pickled by value, so a cluster needs no
# separate installation of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
