"""quillspan: Spark-native operators for page transcripts, catalogues, event logs and corpora."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel by value: executors need Spark and the libraries, not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
