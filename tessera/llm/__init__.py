"""Operators for preparing training corpora.

Nothing outside this package imports it. Functions that run on executors are shipped by value, so a
cluster needs numpy and pyarrow on its workers but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
