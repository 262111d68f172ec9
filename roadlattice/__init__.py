"""Road-network safety and routing analytics as PySpark DataFrame operators."""
