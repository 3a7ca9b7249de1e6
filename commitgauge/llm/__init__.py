"""Operators for preparing training data at scale; nothing else in the library imports this subpackage.

Tasks carry the functions of this package with them, so executors need not have it installed.
"""

from pyspark import cloudpickle

import commitgauge

cloudpickle.register_pickle_by_value(commitgauge)
