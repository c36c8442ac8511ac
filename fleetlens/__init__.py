"""fleetlens: Spark operators over the records of replicated database fleets."""
