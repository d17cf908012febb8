"""Call-record location confidence and integrity analytics on Spark."""
