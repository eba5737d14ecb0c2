"""rankloom: document ranking, evaluation and claim checking as lazy Spark plans."""
