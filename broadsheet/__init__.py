"""broadsheet: news and corpus analytics expressed as Spark DataFrame jobs."""
