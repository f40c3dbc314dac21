"""tessera: Spark-native operators for biomarker matrices, price series and text.

Every operator takes and returns a ``pyspark.sql.DataFrame`` (so it composes with
``df.transform``), is expressed with built-in Spark SQL functions wherever the
semantics allow, and uses seeded md5-based randomness so results are repeatable
and reproducible in any SQL engine that has ``md5``.
"""

from tessera.session import checkpoint_dir, get_spark, ship_package

__all__ = ["get_spark", "checkpoint_dir", "ship_package"]
__version__ = "0.1.0"
