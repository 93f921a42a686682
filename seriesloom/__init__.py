"""Replicated time series, interval and token-set analytics as Spark DataFrame operators."""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Task functions travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
