"""The camera model goes there and back."""

from pyspark.sql import functions as F

from touchline.functions import cameras as C

LENS, VIEW = (0.05, -0.01, 0.001, -0.0005, 0.002), (1500.0, 1500.0, 960.0, 540.0)


def test_ground_points_come_back(spark):
    rows = spark.createDataFrame([(float(x), float(y)) for x in (-20, 0, 35) for y in (-10, 5, 30)], "x double, y double")
    r = C.look_at_rotation(F.lit(0.2), F.lit(0.35), F.lit(0.03))
    rows = rows.select("x", "y", *(c.alias(f"r{i}") for i, c in enumerate(r)))
    r, m = [F.col(f"r{i}") for i in range(9)], [F.lit(2.0), F.lit(12.0), F.lit(70.0)]
    u, v, ahead = C.projected([F.col("x"), F.col("y"), F.lit(0.0)], r, m, VIEW, LENS)
    rows = rows.select("*", u.alias("u"), v.alias("v"), ahead.alias("ahead"))
    rows = rows.select("*", C.undistorted(F.col("u"), F.col("v"), VIEW, LENS).alias("at"))
    gx, gy = C.ground_point(F.col("at"), r, m)
    low = C.meets_plane(C.camera_centre(r, m), C.ray(F.col("at"), r), 2, 0.0)
    for row in rows.select("x", "y", "ahead", gx.alias("gx"), gy.alias("gy"), low[0].alias("lx"), low[1].alias("ly")).collect():
        assert row.ahead and max(abs(row.gx - row.x), abs(row.gy - row.y), abs(row.lx - row.x), abs(row.ly - row.y)) < 1e-2


def test_rotations_and_planes(spark):
    one = spark.range(1)
    still = one.select(*C.rotation_of_vector([F.lit(0.0)] * 3)).first()
    assert list(still) == [1, 0, 0, 0, 1, 0, 0, 0, 1]
    quarter = one.select(*C.rotation_of_vector([F.lit(0.0), F.lit(0.0), F.acos(F.lit(0.0))])).first()
    assert [round(c, 12) for c in quarter] == [0, -1, 0, 1, 0, 0, 0, 0, 1]
    flat, behind = [F.lit(1.0), F.lit(0.0), F.lit(0.0)], [F.lit(0.0), F.lit(0.0), F.lit(1.0)]
    eye = [F.lit(0.0), F.lit(0.0), F.lit(5.0)]
    assert list(one.select(*C.meets_plane(eye, flat, 2, 0.0), *C.meets_plane(eye, behind, 2, 0.0)).first()) == [None] * 4
