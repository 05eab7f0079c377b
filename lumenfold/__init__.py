"""lumenfold: Spark-first analytics over an archive of saved web pages."""
