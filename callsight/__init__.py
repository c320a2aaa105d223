"""callsight: Spark-native analytics over captured HTTP and WebSocket traffic."""

import sys

from pyspark import cloudpickle

# The few Python helpers travel with the tasks, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
