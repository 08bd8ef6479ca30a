"""Operators for training-data pipelines over tables of texts and vectors.

Nothing outside this subpackage imports it. Functions that run inside tasks are shipped by value, so
executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
