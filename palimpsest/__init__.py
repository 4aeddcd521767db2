"""palimpsest: versioned RDF graph analytics on PySpark.

Quads and terms are columnar DataFrames, SPARQL is compiled to the DataFrame
API, and history (commits, branches, merges, provenance) is kept as delta
tables that Catalyst can prune and fold.
"""

__version__ = "0.1.0"
