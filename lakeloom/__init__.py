"""lakeloom: a Spark-first engine for restricted SELECT, log diagnosis, usage roll-ups, rule algebra and table maintenance."""
