"""All queries of the library and their SQL."""

from . import consensus, corpus, samples, shards

PARTS = (corpus, samples, shards, consensus)
QUERIES = {k: f for part in PARTS for k, f in part.QUERIES.items()}
ORACLE = {k: q for part in PARTS for k, q in part.ORACLE.items()}
