"""Finding, resolving, redacting and restoring sensitive spans in text, as Spark DataFrame operators."""
