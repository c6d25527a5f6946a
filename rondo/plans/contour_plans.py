"""Queries of the metric catalogue and of whole contour sets."""

from pyspark.sql import functions as F

from ..operators import contour_sets as C
from .registry import query, table


@query("metric_catalogue", "WITH t(metric, levels, lo, hi) AS (VALUES ('star', 15, 1e0, 15e0), ('ar', 11, 0e0, 10e0), ('od', 11, 0e0, 10e0), ('cs', 11, 0e0, 10e0), ('hp', 11, 0e0, 10e0), ('bpm', 16, NULL, NULL), ('density', 14, NULL, NULL), ('length', 14, NULL, NULL)) SELECT * FROM t")
def metric_catalogue(spark, sf):
    return C.catalogue(spark)


@query("contour_set")
def contour_set(spark, sf):
    p = table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("y"), (F.col("l_discount") * 100).alias("value"))
    return C.contour_set(p, "hp", 40, 1, 2)
