"""docloom: a document-SQL engine and data-processing operators on PySpark."""
