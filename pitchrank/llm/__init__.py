"""Operators for preparing language-model training data."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the Python workers with the plan, so that it
# need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
