"""A PySpark-native engine for report streams: cleaning, entity resolution,
claims, corroboration, trends, coverage and serving, as DataFrame jobs."""
