"""Cash-machine analytics as composable PySpark DataFrame operators."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Send the few Python helpers along with their tasks, so executors need no copy of this package.
register_pickle_by_value(sys.modules[__name__])
