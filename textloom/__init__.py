"""Text and graph analytics as plain PySpark DataFrame operators."""
