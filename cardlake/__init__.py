"""Card-transaction lakehouse on PySpark: Bronze, Silver and Gold layers, SQL and a fraud model."""
