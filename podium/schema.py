"""Schemas of the entities; nothing is inferred at run time."""

from __future__ import annotations

from pyspark.sql import types as T

DEVICE = T.StructType([T.StructField(c, T.StringType()) for c in ("fb_analytics_instance_id", "fb_instance_id", "fcmToken")])

#: A submission as files hold it; times are ISO-8601 text.
SUBMISSION_FILE = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("uid", "email", "authProvider", "appId", "avatar", "geo", "role", "lastLoginAt", "name")]
    + [T.StructField("devices", T.ArrayType(DEVICE)), T.StructField("resources", T.ArrayType(T.StringType()))]
    + [T.StructField(c, T.StringType()) for c in ("created_at", "updated_at")]
    + [T.StructField(c, T.LongType()) for c in ("level", "previousLevel")]
    + [T.StructField("updatedAt", T.StringType()), T.StructField("team", T.LongType())]
)

#: A submission as streams bring it: tolerant of types, cleaned afterwards.
SUBMISSION_JSON = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("uid", "email", "authProvider", "appId", "avatar", "geo", "role", "name", "lastLoginAt")]
    + [T.StructField("devices", T.StringType())]
    + [T.StructField(c, T.StringType()) for c in ("created_at", "updated_at", "updatedAt")]
    + [T.StructField(c, T.DoubleType()) for c in ("level", "previousLevel", "team")]  # text in quotes is no number and so null
)

SCORE = T.StructType(
    [T.StructField("id", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("lastUpdateTime", T.LongType()), T.StructField("previousScore", T.DoubleType())]
)

SNAPSHOT_USER = T.StructType([T.StructField("userId", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("lastUpdateTime", T.LongType())])
SNAPSHOT = T.StructType([T.StructField("_id", T.LongType()), T.StructField("users", T.ArrayType(SNAPSHOT_USER))])

CHANGE = T.StructType(
    [T.StructField("seq", T.LongType()), T.StructField("change_type", T.StringType()), T.StructField("id", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("lastUpdateTime", T.LongType()), T.StructField("previousScore", T.DoubleType())]
)
