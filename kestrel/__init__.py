"""kestrel: a PySpark-native library for building text classifiers without hand labels.

Every operator is a function from DataFrames to DataFrames (or to a Column
expression) that Spark plans and runs; see README.md for the map.
"""

import sys as _sys

# Python workers run the few Arrow batch functions (vector scoring, centroid
# softmax).  Pickle this package's functions by value so workers need no copy
# of the package on their path (a cluster may also ship it with --py-files).
try:
    from pyspark import cloudpickle as _cloudpickle
    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001 - older cloudpickle: ship the package with --py-files instead
    pass

from kestrel.session import get_session, ensure_checkpoint_dir, cut_lineage  # noqa: E402

__all__ = ["get_session", "ensure_checkpoint_dir", "cut_lineage"]
