"""Operators of a training-data pipeline. Nothing outside this folder imports it."""

import sys

from pyspark import cloudpickle

# Task functions travel with the job, so executors need no copy of the repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
