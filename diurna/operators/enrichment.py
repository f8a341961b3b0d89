"""Payloads decoded and places turned into zones, only where that is still missing."""

from __future__ import annotations

import hashlib
import hmac
import os
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import lenient_coordinates

UNKNOWN = "Unknown_Timezone"


def decoder(decode: Callable[[bytes], bytes | str | None]) -> Callable[[Column], Column]:
    """A column function from base64 text to text, by any function on bytes; what fails becomes null."""

    @F.pandas_udf("string")
    def run(payload: pd.Series) -> pd.Series:
        def one(raw):
            if raw is None:
                return None
            try:
                out = decode(bytes(raw))
            except Exception:  # a payload that cannot be read is missing, not an error of the job
                return None
            return out.decode("utf-8", "replace") if isinstance(out, bytes) else out

        return payload.map(one).astype("object")

    return lambda text: run(F.try_to_binary(text, F.lit("base64")))


def encoder(encode: Callable[[bytes], bytes]) -> Callable[[Column], Column]:
    """The way back: text to base64 text."""

    @F.pandas_udf("binary")
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else encode(t.encode()))

    return lambda text: F.base64(run(text))


#: Layout of a sealed payload, version 3 of the RNCryptor format with a password. Fixed values.
VERSION, WITH_PASSWORD = 3, 1
SALT, IV, SEAL, KEY, ROUNDS = 8, 16, 32, 32, 10_000


def _key(password: bytes, salt: bytes) -> bytes:
    return hashlib.pbkdf2_hmac("sha1", password, salt, ROUNDS, KEY)


def unsealed(password: str) -> Callable[[Column], Column]:
    """A column function from sealed base64 text to text; what is no such text, or was altered, becomes null.

    A payload is two bytes of version and kind, two salts, the vector, the AES-256-CBC text and a
    SHA-256 seal over all before it. Keys and seals are computed in Python, the cipher in the JVM.
    """

    @F.pandas_udf("binary")
    def key_of(payload: pd.Series) -> pd.Series:
        def one(raw):
            raw = bytes(raw) if raw is not None else b""
            if len(raw) < 2 + 2 * SALT + IV + 16 + SEAL or raw[0] != VERSION or raw[1] != WITH_PASSWORD:
                return None
            seal = hmac.digest(_key(password.encode(), raw[2 + SALT : 2 + 2 * SALT]), raw[:-SEAL], "sha256")
            return _key(password.encode(), raw[2 : 2 + SALT]) if hmac.compare_digest(seal, raw[-SEAL:]) else None

        return payload.map(one).astype("object")

    def read(text: Column) -> Column:
        raw = F.try_to_binary(text, F.lit("base64"))
        body = F.substr(raw, F.lit(3 + 2 * SALT), F.octet_length(raw) - (2 + 2 * SALT + SEAL))
        return F.try_aes_decrypt(body, key_of(raw), F.lit("CBC"), F.lit("PKCS")).cast("string")

    return read


def sealed(df: DataFrame, text: str, target: str, password: str) -> DataFrame:
    """The way back: adds `target`, the sealed base64 text of a column, with fresh salts in every row."""

    @F.pandas_udf("struct<head binary, vector binary, key binary, lock binary>")
    def drawn(text: pd.Series) -> pd.DataFrame:
        secret = password.encode()
        salts = [(os.urandom(SALT), os.urandom(SALT)) for _ in text]
        return pd.DataFrame([(bytes([VERSION, WITH_PASSWORD]) + a + b, os.urandom(IV), _key(secret, a), _key(secret, b)) for a, b in salts], columns=["head", "vector", "key", "lock"])

    @F.pandas_udf("binary")
    def seal(lock: pd.Series, body: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else hmac.digest(bytes(k), bytes(b), "sha256") for k, b in zip(lock, body, strict=True)], dtype="object")

    m = F.col("_drawn")
    out = df.withColumn("_drawn", drawn.asNondeterministic()(F.col(text)))
    out = out.withColumn("_body", F.concat(m["head"], F.aes_encrypt(F.col(text).cast("binary"), m["key"], F.lit("CBC"), F.lit("PKCS"), m["vector"])))
    return out.withColumn(target, F.base64(F.concat("_body", seal(m["lock"], F.col("_body"))))).drop("_drawn", "_body")


def decrypted_where_missing(df: DataFrame, payload: str, target: str, decode: Callable[[Column], Column]) -> DataFrame:
    """Fills `target` where it is null; the payload `none` reads as None."""
    return df.withColumn(target, F.coalesce(F.col(target), F.when(F.lower(payload) == "none", "None").otherwise(decode(F.col(payload)))))


def zones_by_box(places: DataFrame, boxes: DataFrame, row_id: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Adds timezone_id from boxes (timezone_id, south, north, west, east); of several the smallest, then by name.

    Boxes are laid out on cells of one degree, so places meet boxes in a join on their cell.
    """
    cells = boxes.withColumn("_y", F.explode(F.sequence(F.floor("south"), F.floor("north")))).withColumn("_x", F.explode(F.sequence(F.floor("west"), F.floor("east"))))
    at = places.withColumns({"_y": F.floor(lat), "_x": F.floor(lon)})
    met = at.join(cells, (at._y == cells._y) & (at._x == cells._x) & F.col(lat).between(F.col("south"), F.col("north")) & F.col(lon).between(F.col("west"), F.col("east")))
    area = (F.col("north") - F.col("south")) * (F.col("east") - F.col("west"))
    best = met.groupBy(row_id).agg(F.min_by("timezone_id", F.struct(area, "timezone_id")).alias("timezone_id"))
    return places.join(best, row_id, "left").withColumn("timezone_id", F.coalesce("timezone_id", F.lit(UNKNOWN)))


def zones_by_polygon(places: DataFrame, polygons: DataFrame, row_id: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Adds timezone_id from polygons (timezone_id, rings: array of arrays of (lon, lat)); of several the smallest box, then by name.

    A place is inside if a line to the east crosses the rings an odd number of times, so rings within
    rings are holes. Cells of one degree choose the polygons that are tested; rings follow by number.
    """
    points = F.flatten("rings")
    edge = lambda f, c: f(F.transform(points, lambda p: p[c]))
    shapes = polygons.select("timezone_id", "rings", *(edge(f, c).alias(n) for n, f, c in (("south", F.array_min, "lat"), ("north", F.array_max, "lat"), ("west", F.array_min, "lon"), ("east", F.array_max, "lon"))))
    shapes = shapes.withColumn("_shape", F.xxhash64("timezone_id", "rings")).dropDuplicates(["_shape"])
    cells = shapes.select("_shape", F.explode(F.sequence(F.floor("south"), F.floor("north"))).alias("_y"), "west", "east").select("_shape", "_y", F.explode(F.sequence(F.floor("west"), F.floor("east"))).alias("_x"))
    known = places.select(row_id, F.col(lat).cast("double").alias("_lat"), F.col(lon).cast("double").alias("_lon"), F.floor(lat).alias("_y"), F.floor(lon).alias("_x"))
    met = known.join(cells, ["_y", "_x"]).join(shapes, "_shape")

    def crossed(a: Column, b: Column) -> Column:
        east = (b["lon"] - a["lon"]) * (F.col("_lat") - a["lat"]) / (b["lat"] - a["lat"]) + a["lon"]
        return ((a["lat"] > F.col("_lat")) != (b["lat"] > F.col("_lat"))) & (F.col("_lon") < east)

    def crossings(ring: Column) -> Column:
        return F.size(F.filter(F.sequence(F.lit(1), F.size(ring)), lambda i: crossed(F.element_at(ring, i), F.element_at(ring, F.when(i == F.size(ring), 1).otherwise(i + 1)))))

    total = F.aggregate("rings", F.lit(0), lambda acc, ring: acc + F.when(F.size(ring) > 0, crossings(ring)).otherwise(0))
    area = (F.col("north") - F.col("south")) * (F.col("east") - F.col("west"))
    best = met.where(total % 2 == 1).groupBy(row_id).agg(F.min_by("timezone_id", F.struct(area, "timezone_id")).alias("timezone_id"))
    return places.join(best, row_id, "left").withColumn("timezone_id", F.coalesce("timezone_id", F.lit(UNKNOWN)))


def zones_where_missing(location: DataFrame, boxes: DataFrame, row_id: str = "_id") -> DataFrame:
    """Fills timezone_id of rows that have none from their packed coordinates."""
    missing = location.where("timezone_id is null").drop("timezone_id").withColumn("_c", lenient_coordinates(F.col("location_decrypted"))).select("*", F.col("_c.lat").alias("_lat"), F.col("_c.lon").alias("_lon")).drop("_c")
    found = zones_by_box(missing, boxes, row_id, "_lat", "_lon").drop("_lat", "_lon")
    return location.where("timezone_id is not null").unionByName(found)
