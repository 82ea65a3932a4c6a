"""edgeloom: code-graph facts and corpus hygiene as Spark DataFrame operators."""
