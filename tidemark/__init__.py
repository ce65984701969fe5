"""tidemark: change-log recovery and fleet-health analytics on Spark."""
