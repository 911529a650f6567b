"""marketframe: set-based marketplace data logic on Spark DataFrames.

Every public function takes DataFrames (plus plain Python parameters) and
returns DataFrames.  Nothing is collected to the driver; the only actions
happen in sinks, tests and the benchmark.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

from marketframe.session import get_spark, checkpoint_dir

# The few pandas functions (login replay, streaming state) must reach Python
# workers even when this package is not installed on the executors, so its
# functions are pickled by value instead of by module reference.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

__all__ = ["get_spark", "checkpoint_dir"]
