"""What reaches the driver unasked is decided by counted bytes, never by the size of compressed files."""

from pulseframe.plans.views import points_view
from pulseframe.session import cut_lineage, tune


def test_points_pass_for_small_by_their_files_only(spark, tmp_path):
    """Generated rows of a small file: more than the limit together, so neither side may be broadcast."""
    counted = "spark.sql.adaptive.autoBroadcastJoinThreshold"
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1m")
    spark.conf.unset(counted)
    try:
        tune(spark)
        points = points_view(spark, "/root/testdata/sf0.01").select("point_id", "x", "y", "z")
        for rows in (points, cut_lineage(points)):
            joined = rows.join(rows.withColumnRenamed("x", "x2").select("point_id", "x2"), "point_id")
            joined.write.format("noop").mode("overwrite").save()
            static = joined._jdf.queryExecution().sparkPlan().toString()
            assert "Broadcast" not in static
        assert spark.conf.get(counted) == "1m"
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset(counted)
        tune(spark)
