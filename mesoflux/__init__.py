"""A PySpark-native analytics engine for station, weather-model and sky-camera data."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so that workers need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
