"""Retrieval and recommendation over large document collections, as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions handed to Python workers travel with the plan, so executors need no
# copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
