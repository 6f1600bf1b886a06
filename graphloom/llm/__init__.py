"""Operators of a training-data pipeline, each a DataFrame-to-DataFrame function.

The package is shipped to Python workers by value, so executors need not have
it installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
