"""loomwork: evidence retrieval and fact analytics expressed as Spark plans."""
