"""kbspark: knowledge-base building and question answering as Spark plans.

Documents and pages become headed sections, tagged sentences, entities,
frames and an inverted index; questions are answered against those tables
by blocked fuzzy entity lookup, relational division by heading, frame
filtering, scoring, top-k ranking and neighbour-sentence assembly.
"""

__all__ = ["session"]

# Functions of this package used inside Python UDFs / mapInPandas are shipped
# to the workers by value, so executors need no installed copy of it.
from pyspark import cloudpickle as _cloudpickle  # noqa: E402
import sys as _sys  # noqa: E402

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
