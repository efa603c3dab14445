"""Operations for preparing training data; nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Functions of this package travel with the tasks, so executors need no copy of it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
