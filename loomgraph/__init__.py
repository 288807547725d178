"""RDF graphs on Spark: SPARQL, updates, reasoning and validation as DataFrames."""
