"""Spark-first engine for auditable text-to-preference-data pipelines."""

import sys

from pyspark import cloudpickle

# Executors need no copy of this package: its functions travel inside the tasks that use them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
