"""Online-shop analytics as lazy PySpark DataFrame operators."""
