"""quern: a PySpark-native retrieval, graph and corpus-processing engine.

Every public operator takes and returns DataFrames or Columns.  Functions that
run in Python workers are pickled by value, so executors need not have this
package on their path.
"""

from pyspark import cloudpickle as _cloudpickle
import sys as _sys

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
