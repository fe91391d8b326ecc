"""gridloom: DataFrame operators for gridded, entity and record data on Apache Spark."""
