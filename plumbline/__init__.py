"""plumbline: dataset validation operators on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel with the task, so workers need not have this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
