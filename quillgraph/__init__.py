"""Spark-native analytics over citation corpora: slots, matching, dyads, graphs, statistics."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel whole, so a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
