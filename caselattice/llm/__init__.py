"""Training-data operators. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions travel to the executors whole: those need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
