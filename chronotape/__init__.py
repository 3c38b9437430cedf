"""Point-in-time analytics over client event tapes, written as Spark jobs."""
