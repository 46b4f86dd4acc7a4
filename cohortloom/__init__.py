"""Cohort analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# executors receive the few Python helpers by value, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
