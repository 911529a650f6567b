"""Operators for building language-model training data, one module each.

Every operator takes and returns DataFrames.  Python tasks use numpy over
bounded slices; the work is partitioned and shuffled by Spark.  The package
is pickled by value, so executors need no installed copy."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
