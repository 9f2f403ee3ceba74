"""linkatlas: Spark jobs over saved-link collections, the pages behind them and the log of fetching them."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python functions of this package travel to the executors by value, so nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
