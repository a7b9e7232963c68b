"""Operators that prepare text corpora for training language models.

Nothing outside this folder imports it.  Functions sent to Python workers are
pickled by value, so that executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
