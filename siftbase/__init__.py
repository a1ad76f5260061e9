"""Knowledge-base analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Python workers need no installed copy of this package: its functions travel with the tasks.
# Such a function may use names of its module, but no other module of this package as a whole.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
