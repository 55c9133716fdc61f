"""Document retrieval, corpus quality and ledger analytics as Spark DataFrame operators."""
