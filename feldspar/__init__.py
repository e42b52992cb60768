"""feldspar: governed retrieval and analytics expressed as Spark DataFrame plans."""
