"""Domain relations over the supplied tables: as DataFrames, and as SQL for the oracles."""
