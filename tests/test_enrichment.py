"""Payloads and zones."""

import base64
import random

from pyspark.sql import functions as F

from diurna.operators import enrichment


def test_payloads_are_read_where_missing(spark):
    flip = lambda raw: bytes(b ^ 7 for b in raw)
    df = spark.createDataFrame([(1, "44.0 | 1.0", None), (2, "none", None), (3, "x", "kept"), (4, None, None)], "i int, t string, target string")
    df = df.withColumn("p", F.when(F.col("i") == 2, "none").otherwise(enrichment.encoder(flip)(F.col("t"))))
    got = [r.target for r in enrichment.decrypted_where_missing(df, "p", "target", enrichment.decoder(flip)).orderBy("i").collect()]
    assert got == ["44.0 | 1.0", "None", "kept", None]


def test_failing_codec_gives_null(spark):
    def broken(raw):
        raise ValueError

    df = spark.createDataFrame([("YQ==",), ("*",), (None,)], "p string")
    assert [r[0] for r in df.select(enrichment.decoder(broken)(F.col("p"))).collect()] == [None] * 3


def test_smallest_box_wins_and_outside_is_unknown(spark):
    boxes = spark.createDataFrame([("big", 40.0, 50.0, -5.5, 5.5), ("small", 44.0, 45.5, -1.0, 1.0)], "timezone_id string, south double, north double, west double, east double")
    p = spark.createDataFrame([(1, 44.5, 0.0), (2, 41.0, -5.2), (3, 0.0, 0.0), (4, None, 1.0), (5, 45.5, 1.0)], "i int, lat double, lon double")
    assert [r.timezone_id for r in enrichment.zones_by_box(p, boxes, "i").orderBy("i").collect()] == ["small", "big", "Unknown_Timezone", "Unknown_Timezone", "small"]


def test_sealed_payloads(spark):
    texts = ["44.1 | -63.2 | 10", "", "é" * 100, None, "x" * 16]
    df = enrichment.sealed(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), "t", "p", "secret").persist()
    rows = df.orderBy("i").collect()
    assert [r.t for r in df.orderBy("i").select(enrichment.unsealed("secret")(F.col("p")).alias("t")).collect()] == texts
    assert {r.t for r in df.select(enrichment.unsealed("other")(F.col("p")).alias("t")).collect()} == {None}
    raw = [base64.b64decode(r.p) for r in rows if r.p]
    assert all(x[:2] == bytes([3, 1]) and (len(x) - 66) % 16 == 0 for x in raw) and len({x[2:34] for x in raw}) == len(raw)
    bad = [base64.b64encode(raw[0][:k] + bytes([raw[0][k] ^ 1]) + raw[0][k + 1 :]).decode() for k in (0, 1, 5, 30, 40, len(raw[0]) - 1)] + ["", "AwE=", "*"]
    assert {r.t for r in spark.createDataFrame([(b,) for b in bad], "p string").select(enrichment.unsealed("secret")(F.col("p")).alias("t")).collect()} == {None}
    df.unpersist()


def inside(lon, lat, rings):
    n = 0
    for ring in rings:
        for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1], strict=True):
            n += (y0 > lat) != (y1 > lat) and lon < (x1 - x0) * (lat - y0) / (y1 - y0) + x0
    return n % 2 == 1


def test_polygons_with_holes(spark):
    shapes = {"ring": [[(0, 0), (10, 0), (10, 10), (0, 10)], [(4, 4), (6, 4), (6, 6), (4, 6)]], "wedge": [[(4.5, 4.5), (7.5, 5.0), (5.0, 7.5)]], "far": [[(-20.5, -3), (-15, -3), (-17, 2.5)], []]}
    polygons = spark.createDataFrame([(z, [[{"lon": float(x), "lat": float(y)} for x, y in ring] for ring in rings]) for z, rings in shapes.items()], "timezone_id string, rings array<array<struct<lon:double,lat:double>>>")
    rng = random.Random(1)
    at = [(i, rng.uniform(-4, 11), rng.choice([rng.uniform(-1, 11), rng.uniform(-21, -14)])) for i in range(400)] + [(400, None, 1.0)]
    got = {r.i: r.timezone_id for r in enrichment.zones_by_polygon(spark.createDataFrame(at, "i int, lat double, lon double"), polygons, "i").collect()}
    for i, lat, lon in at:
        expected = next((z for z in ("wedge", "far", "ring") if lat is not None and inside(lon, lat, shapes[z])), "Unknown_Timezone")
        assert got[i] == expected
    assert len(set(got.values())) == 4
