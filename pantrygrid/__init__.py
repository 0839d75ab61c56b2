"""Food-composition planning, text retrieval and their measurement as Spark jobs."""
