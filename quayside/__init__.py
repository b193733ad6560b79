"""Market-microstructure analytics as declarative Spark plans."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel whole: workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
