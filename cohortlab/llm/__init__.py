"""Operators for preparing training text: packing, language id, licence scans,
URL filters, n-gram Jaccard join, secret scans, quality rules, benchmark
decontamination, token counts and resolution of not-modified captures.

Nothing else in the library imports this subpackage.
"""

import sys

from pyspark import cloudpickle

# Executors need not have this package: what runs in tasks is sent with them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
