"""Operators for large-scale training-data preparation.

One module per operator, each with a general DataFrame interface; ``queries``
holds the thin registered queries and ``sql`` their DuckDB statements.
Nothing outside this subpackage imports it (``corpus_pipeline`` belongs to it).
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions of this subpackage travel to the executors by value, so a session
# works whether or not the package is installed there.
register_pickle_by_value(sys.modules[__name__])
