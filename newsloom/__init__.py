"""Spark-native engine for news-style corpora.

Reads article records and crawled pages, cleans and chunks them, keeps an
incrementally updated chunk table, and answers vector, keyword, hybrid and
recency queries plus the reports built on top of them.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions used inside tasks travel with the plan, so executors need pyspark,
# numpy and pyarrow but no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
