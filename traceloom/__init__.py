"""traceloom: clustered sequence-read analytics expressed as Spark DataFrame jobs."""
