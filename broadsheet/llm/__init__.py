"""Operations of a training-data pipeline: sharding, packing, quality scoring,
nearest neighbours, exact top-k, URL filters, chat formatting, WARC, near
duplicates and source mixing. Nothing else in the library imports this package.

The package travels to the Python workers by value, so a cluster needs no
installed copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
