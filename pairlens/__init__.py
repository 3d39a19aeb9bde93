"""pairlens: relate two wide per-entity feature views with Spark DataFrames.

The library is built on two distributed primitives: a grouped second-moment
aggregation (`operators.moments`) and a row-wise linear map (`operators.linear`).
Residualizing, scaling, PCA, (sparse) canonical correlation, cross-validated
grids and permutation tests are all functions of the aggregated moments.
"""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Functions that run in Python workers are shipped by value, so executors need no
# installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
