"""cataloom: catalogs of extracted business logic, kept and queried as Spark DataFrames."""
