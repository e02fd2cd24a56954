"""Context-vote label recovery over token sequences, expressed as Spark DataFrames."""
