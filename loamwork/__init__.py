"""loamwork: a Spark-native engine for corpus, trace, retrieval and training-data queries.

Functions that run in Python workers are pickled by value, so executors need
only the third-party libraries, not a copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
