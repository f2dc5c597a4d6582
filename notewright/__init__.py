"""notewright: Spark-native operators for timed, pitched lyric data."""
