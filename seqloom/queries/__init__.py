"""The core's queries over the test tables, each with the same result in SQL where SQL can express it."""

from seqloom.queries import alignments, contracts, formats, graph, groups, hits, profiles, records, rules, search, stats, texts, trees  # noqa: F401
from seqloom.queries.registry import QUERIES, SQL  # noqa: F401
