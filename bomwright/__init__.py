"""Product-lifecycle and bill-of-materials analytics as Spark DataFrame plans."""
