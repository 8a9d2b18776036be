"""Operators of a training-data pipeline: cleaning, deduplication, mixing,
sharding, formatting and tokenisation of document tables.

Nothing else in the library imports this subpackage.  Every operator is a
function ``DataFrame -> DataFrame``.  Code that runs in tasks is shipped by
value, so the workers need no installed package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
