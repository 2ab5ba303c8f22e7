"""PySpark-native analytics engine for paired physiological time series and clinical records."""

import sys

from pyspark import cloudpickle

# Functions that Spark ships to executors travel with their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
