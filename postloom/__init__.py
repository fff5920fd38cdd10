"""Text and embedding analytics for short posts, written on Spark DataFrames."""

import sys

from pyspark.cloudpickle.cloudpickle import register_pickle_by_value

# Functions that run inside tasks travel with their code, so executors need no copy of
# this package.
register_pickle_by_value(sys.modules[__name__])
