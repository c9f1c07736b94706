"""Clinical-quality expressions compiled to Spark plans for whole populations."""
