"""A document-intelligence and hybrid-retrieval engine on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel by value, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
