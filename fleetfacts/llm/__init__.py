"""Operators of a training-data pipeline; nothing else in the package imports this folder.

Their task code is sent to the executors by value, so the package need not be installed there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
