"""Batch cited retrieval, citation checking and retrieval evaluation on Spark.

Every operator takes DataFrames keyed by ``query_id`` (or ``doc_id``, ``run`` …)
and answers the whole batch in one job.
"""

__version__ = "0.1.0"
