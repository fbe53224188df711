"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage; the top module ``corpus_pipeline``
belongs to it.
"""

import sys

from pyspark import cloudpickle

# Functions travel to the executors by value: these need not have the library installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
