"""quire: turn large document collections into Markdown tables with Spark.

Every step is a DataFrame-in, DataFrame-out operator; see ``README.md`` for the
map from features to modules.
"""

import sys

from pyspark import cloudpickle

from quire.options import Options

# The helpers of the Python stages travel inside the tasks, so executors need no copy of
# this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Options"]
