"""assetspark: image-asset analytics as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Functions shipped to Python workers travel by value, so executors need no
# copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
