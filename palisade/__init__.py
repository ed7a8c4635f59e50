"""palisade: security-log and corpus analytics written as Spark DataFrame programs."""
