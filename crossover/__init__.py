"""crossover: migration assessment, load, sync and validation on Spark, for many databases at once."""
