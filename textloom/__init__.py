"""textloom: document and transcript analytics as PySpark DataFrame operators."""
