"""Retrieval, web-graph and text analytics on Spark DataFrames.

Functions of this package that run on executors travel by value, so executors need no copy of it installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
