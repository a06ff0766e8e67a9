"""Set-oriented analytics over columnar tables, expressed as Spark DataFrame plans."""
