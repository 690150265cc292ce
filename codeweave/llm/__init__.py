"""Training-data operators.  Nothing else in the library imports this subpackage."""

from pyspark import cloudpickle as _cloudpickle

import codeweave.llm as _self

# Executors get the functions of this subpackage by value, so that a cluster
# needs no installed copy of it.
_cloudpickle.register_pickle_by_value(_self)
