"""Training and scoring."""

import sys

from pyspark import cloudpickle

# What runs in the Python workers travels with the plan; the package need not be there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
