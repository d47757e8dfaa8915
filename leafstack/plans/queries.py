"""All core queries and their SQL."""

from leafstack.plans import documents, models, retrieval, store  # noqa: F401
from leafstack.plans.base import QUERIES, SQL


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
