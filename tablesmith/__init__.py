"""Spark-native table profiling, preparation and supervised model evaluation."""

import sys

from pyspark import cloudpickle

# The few functions that run inside Python tasks travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
