"""nighspark: proximity joins (distance, predicate, nearest-neighbour, space-time) on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Executors get the functions of this package with the plan, so a session works without installing it on every node.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
