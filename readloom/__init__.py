"""readloom: long-read sketching, overlap, layout and consensus as Spark jobs."""

import sys

from pyspark import cloudpickle

from readloom.config import AssemblyConfig

__all__ = ["AssemblyConfig"]

# task functions carry the package with them, so executors need no installation
cloudpickle.register_pickle_by_value(sys.modules[__name__])
