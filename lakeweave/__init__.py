"""Lakeweave: finding, aligning and adapting tables of a data lake on Spark."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the plan, so workers need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
