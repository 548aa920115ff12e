"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# functions travel to the executors whole, so that these need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
