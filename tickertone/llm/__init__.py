"""Operators for training-data preparation; nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Workers may start elsewhere, so functions of this package travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
