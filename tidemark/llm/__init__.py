"""Operators for training-data pipelines: deduplication, scans, scoring, mixing, token files.

Task functions of this package travel to the workers by value, so workers need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
