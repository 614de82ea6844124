"""Operators for large training-data pipelines (quality, near-duplicates, sharding, mixing, search, scoring, scans, packing)."""

import sys

from pyspark import cloudpickle

# functions that run in tasks travel with their code, so workers need no installed copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
