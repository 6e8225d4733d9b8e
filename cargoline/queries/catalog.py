"""All registered queries."""

from cargoline.queries import (file_queries, knowledge_queries, linear_queries, match_queries, model_queries, report_queries,  # noqa: F401
                               standard_queries, text_queries)
from cargoline.queries.registry import ORACLES, QUERIES  # noqa: F401


def flagship(spark, sf_dir):
    """Classify every declaration; rows and share of each status."""
    from cargoline.operators import report

    out = model_queries.classified(spark, sf_dir)
    return report.pattern_report(out, "status")
