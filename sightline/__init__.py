"""Spark jobs for tracking listings that appear, change and disappear across many portals."""

import sys

from pyspark import cloudpickle

# The few Python helpers travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
