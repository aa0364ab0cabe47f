"""Operators for large training-data pipelines. Nothing outside this folder imports it (the registry in
``__spark_entry__.py`` adds its queries only when it is present)."""
