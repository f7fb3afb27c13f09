"""Lodestow: a PySpark-native analytics engine for cargo, ledger, text and event data."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the job, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
