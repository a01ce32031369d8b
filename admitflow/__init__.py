"""admitflow: table-to-table admissions matching, text and retrieval operators on Spark."""
