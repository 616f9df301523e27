"""ledgerloom: a PySpark-native engine for catalogues of filings, their facts and their texts."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions travel to the executors by value: these need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
