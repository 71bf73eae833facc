"""Spark-native preparation and reconciliation of accounting data.

Subpackages: ``functions`` (scalar expressions), ``operators`` (DataFrame to DataFrame),
``sources`` (readers and writers), ``plans`` (the query catalogue), ``streaming``.
"""

import sys

from pyspark import cloudpickle

# functions that run inside Python workers travel with the job, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
