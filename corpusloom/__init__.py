"""A document-corpus engine on Spark DataFrames."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions sent to executors carry their code, so that those needn't have the package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
