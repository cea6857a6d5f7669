"""Beacon analytics as Spark jobs: packets, connections, windows, scores, alerts, attribution."""

import sys

from pyspark import cloudpickle

# Python helpers travel with the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
