"""textloom: text and graph analytics as DataFrame programs on Spark."""
