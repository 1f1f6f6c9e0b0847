"""Operators for preparing training data: deduplication, packing, archives, search, scoring.

Functions that run in tasks travel with the tasks, so the package need not be
installed on the executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
