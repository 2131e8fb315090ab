"""tallyloom: Spark-native analytics over records, predictions, losses and vectors."""

import sys

from pyspark import cloudpickle

# functions shipped to executors travel with the job, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
