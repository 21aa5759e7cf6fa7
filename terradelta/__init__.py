"""Spark jobs for versioned map layers, event feeds and market archives."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the Python workers by value, so a job also runs where only
# the driver has the package on its path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
