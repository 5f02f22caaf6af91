"""Training-data operators: filtering, near-duplicates, counts, scoring and mixing.

Each module holds one operator with its general interface; ``queries`` applies
them to the given tables and derives the registered result columns.
"""

import sys

from pyspark import cloudpickle

# Functions of this package go to the Python workers by value: executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
