"""mirador: a Spark-native engine for web-entity data (pages, blocks, entities, evidence, points)."""
