"""Sensor-stream analytics as composable Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel with their code, so executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
