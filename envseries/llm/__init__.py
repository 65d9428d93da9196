"""Operators of a training-data pipeline over the tables documents, pages, benchmark and labels.

Every module holds one operator with its own interface; ``catalog`` registers one query per operator.
Nothing else in the library imports this package.
"""

import sys

from pyspark import cloudpickle

# executors get this package's functions with each task, so they need no copy of it on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
