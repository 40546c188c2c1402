"""Plans: operators put together for ingestion, answering and the registered queries."""
