"""Log-session and trace analytics on Spark: DataFrames in, DataFrames out."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so that nothing needs to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
