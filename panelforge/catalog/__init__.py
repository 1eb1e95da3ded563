"""Registered queries and the SQL they are checked against."""

from panelforge.catalog import (  # noqa: F401
    fitted_queries,
    metric_queries,
    model_queries,
    page_queries,
    prepare_queries,
    profile_queries,
    survey_queries,
)
from panelforge.catalog.registry import REGISTRY  # noqa: F401
