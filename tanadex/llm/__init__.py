"""Operators of a training-data pipeline. Nothing outside this package imports it."""

import sys

from pyspark import cloudpickle

# Functions that run on executors are sent by value, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
