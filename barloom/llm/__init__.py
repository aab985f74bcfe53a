"""Operators for building training corpora: deduplication, decontamination, quality, token counts, archives, mixing.

Nothing else in the package imports this subpackage. Every module holds one operator; ``queries`` registers them.
"""

import sys

from pyspark import cloudpickle

# functions of this subpackage travel to the executors with their code, which need not have it installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
