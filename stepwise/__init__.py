"""stepwise: iterative dataflow with per-key history, expressed as Spark plans."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers are shipped by value, so that executors
# need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
