"""Spark-native analytics over long recordings: clips, annotations, scores, detections."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Kernels travel to the executors inside the task, so no executor needs this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
