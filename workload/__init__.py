"""The library's operators on the driver's tables, each with the same result in SQL."""

from workload.registry import ORACLE, QUERIES  # noqa: F401
from workload import alignments, annotations, edges, files, reads, targets  # noqa: F401,E402  (importing registers the queries)
