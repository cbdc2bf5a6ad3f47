"""memloom: a Spark-first analytics engine for conversation memory."""

import sys

from pyspark import cloudpickle

# Worker processes receive the package's functions by value, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
