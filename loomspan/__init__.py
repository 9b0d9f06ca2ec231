"""A text analytics engine on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Executors needn't have the package: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
