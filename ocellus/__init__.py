"""Spark-first analytics over object detections, cohorts and training corpora."""

import sys

from pyspark import cloudpickle

# Python workers may run where this package is not importable (the driver need
# not ship the repository): functions of the package travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
