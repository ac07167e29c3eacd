"""Operators for preparing language-model training data.

Nothing else in the package imports this subpackage. Code that runs on executors
is shipped by value, so executors need no install of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
