"""The query catalogue: Spark plans and their SQL counterparts."""
