"""Part of the folioscope engine. Its functions travel to the executors by value, which needn't have the package."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
