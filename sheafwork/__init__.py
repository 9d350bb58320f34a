"""sheafwork: page geometry, quote tables and their cleaning as Spark DataFrames."""
