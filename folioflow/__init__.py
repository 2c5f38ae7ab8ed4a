"""folioflow: a PySpark-native engine for corpora of structured documents.

Building blocks: :mod:`folioflow.sources` (typed readers and writers),
:mod:`folioflow.functions` (column functions), :mod:`folioflow.operators`
(DataFrame -> DataFrame operators), :mod:`folioflow.plans` (named queries with
their SQL twins) and :mod:`folioflow.streaming`.
"""

import sys

from pyspark import cloudpickle

# Python workers get the package's functions by value, so that a session works
# without the package being installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
