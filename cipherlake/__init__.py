"""cipherlake: a Spark-native engine for cryptographic inventory and migration risk."""
