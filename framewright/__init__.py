"""Spark-native analytics over ordered vector sequences, aligned pairs, segments and their evaluation."""
