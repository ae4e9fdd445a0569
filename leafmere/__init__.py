"""Document analytics on PySpark: filters, search, history and change feeds as DataFrame plans."""
