"""Document analytics over whole corpora, expressed as Spark DataFrame transformations."""
