"""All registered queries with their SQL."""

from matchloom.plans import balancing, checks, evaluation, folds, forecasting, intake, models, relational, resampling, selection, shapes, stores, studies  # noqa: F401
from matchloom.plans.registry import QUERIES, SQL  # noqa: F401
