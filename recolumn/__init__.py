"""recolumn: recommender analytics expressed as Spark DataFrame jobs."""
