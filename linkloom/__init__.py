"""Entity resolution and link analysis over observation tables, as Spark jobs."""
