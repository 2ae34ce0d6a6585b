"""corrobora: analyses that check themselves, as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few Python helpers that run on executors travel with the job; nothing needs installing there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
