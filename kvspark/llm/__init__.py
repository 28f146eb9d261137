"""Operators for large text corpora. Nothing else in the package imports this one.

Functions that run in Python workers are pickled by value, so executors need not have
this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
