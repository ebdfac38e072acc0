"""Operators that prepare training data. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to Python workers whole, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
