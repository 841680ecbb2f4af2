"""All registered queries of the library's own operators."""

from casefile.plans import table_queries, text_queries  # noqa: F401
from casefile.plans.registry import QUERIES, SQL  # noqa: F401
