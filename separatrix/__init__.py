"""Supervised classification on Spark tables and streams."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the tasks as code, so executors need not
# have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
