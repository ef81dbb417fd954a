"""Training-data operators: dedup, PII, packing, quality, language, URL and benchmark filters.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it. Functions
of this package that run inside Spark tasks are shipped by value, so executors
need the installed libraries but no copy of this repository on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
