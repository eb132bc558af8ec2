"""Operators that prepare training text. Nothing outside this folder imports them."""

import sys

from pyspark import cloudpickle

# Functions of this folder travel to the executors by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
