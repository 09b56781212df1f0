"""Training-data operators (packing, scoring, deduplication, scans) and their
registered queries.  Nothing outside this folder imports it; the driver entry
adds its queries only when it can be imported."""


def load_all():
    """(queries, oracle SQL) of every operator module of this subpackage."""
    from . import queries
    return queries.QUERIES, queries.ORACLE_SQL
