"""Operators for large training-text corpora. Nothing else in the library imports this package.

Functions that run in tasks are sent with the job, so executors need not have the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
