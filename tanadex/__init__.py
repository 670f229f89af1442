"""Listing tracking and catalogue search as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run on executors are sent by value, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
