"""Operators for large training-text corpora; nothing else in the library imports this package.

Functions of this package that run inside tasks are shipped by value, so executors need
only the third-party libraries, not this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
