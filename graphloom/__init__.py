"""graphloom: declarative tabular-to-RDF mapping on Spark DataFrames."""
