"""Training-data preparation operators: one module per operator, each a Spark job over a documents-like table."""
