"""Operators of a training-data pipeline: search, deduplication, mixing, packing, privacy, toxicity, licences."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions that run in tasks travel with the plan: executors need no copy of this package.
register_pickle_by_value(sys.modules[__name__])
