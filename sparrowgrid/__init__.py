"""sparrowgrid: word lookup, list ingest, ordered state and array analytics as Spark plans."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers carry their code with them, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
