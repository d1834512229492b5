"""Operators of a training-data pipeline: quality, deduplication, mixing, tokens, search and scoring."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors with their tasks, so a cluster
# needs no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
