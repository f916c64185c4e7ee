"""tessera: evidence-bounded corpus analytics, expressed as Spark DataFrame plans."""
