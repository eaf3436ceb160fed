"""Analytics over corpora of conversations and labelled text, built on Spark DataFrames.

Worker functions are pickled by value, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
