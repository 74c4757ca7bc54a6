"""Associative-memory analytics as Spark plans.

Records and co-activation events go in; a decaying association graph, ranked
retrieval over it, evidence packets and evaluation tables come out.  Every
operator takes and returns DataFrames, and batches over a ``query_id`` column
instead of being called once per query.
"""
