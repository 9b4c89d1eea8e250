"""Training-data operators: quality, extraction, search, mixing, joins, tokens, PII.

Nothing else in the library imports this subpackage.  Functions that run in
tasks are pickled by value, so executors need only numpy, pyarrow and the
other third-party libraries, not an installed copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
