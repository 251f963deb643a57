"""gravis: severity-rate analytics and classification on Spark DataFrames.

Every public operator takes and returns a ``pyspark.sql.DataFrame`` (or a
Column expression) and is built from native Spark SQL functions and Spark ML
stages, so Catalyst prunes, pushes down and codegens the whole plan.
"""

from gravis.session import get_spark, ensure_checkpoint_dir  # noqa: F401

# Fixed values of the reference's data model: the three severity classes in
# the sorted order that its label encoder gives them, and the sentinel strings.
SEVERITY_CLASSES = ("FATAL", "GRAVE", "LEVE")
NOT_AVAILABLE = "NAO DISPONIVEL"
UNKNOWN = "DESCONHECIDO"
MISSING = "MISSING"
