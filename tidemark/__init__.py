"""tidemark: memory analytics over episodes, entities and facts, written as Spark jobs."""
