"""All published queries, gathered from the plan modules."""

from __future__ import annotations

from quillspan.plans import registry
from quillspan.plans import evaluation, history, ingest, presentation, references, retrieval, verification  # noqa: F401


def queries():
    return registry.builders()


def oracle_sql():
    return registry.oracles()
