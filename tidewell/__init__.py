"""Tidewell: analysis and compact storage of series and tables, on Spark.

Functions of this package that run on executors are shipped by value, so
nothing has to be installed there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
