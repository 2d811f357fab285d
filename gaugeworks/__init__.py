"""A PySpark engine for evaluating text models and auditing training corpora."""
