"""Customer-behaviour analytics on Spark: ingest, features, exploration, forests, scoring."""
