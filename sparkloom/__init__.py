"""A PySpark-native engine for text and repository analytics."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the plan, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
