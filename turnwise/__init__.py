"""turnwise: a PySpark-native engine for curating multi-turn retrieval dialogues."""
