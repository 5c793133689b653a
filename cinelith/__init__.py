"""cinelith: PySpark-native analytics over chunked game-movie containers."""
