"""Network-flow detection and analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions handed to Spark travel with the task: executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
