"""Section-revision analytics on Spark: every stage takes DataFrames and returns a DataFrame."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so executors need not install this.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
