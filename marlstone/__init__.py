"""marlstone: document-to-table analytics as Spark DataFrame and SQL operators."""
