"""Operators for preparing training corpora.  Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# ship the worker functions by value: executors need no installed copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
