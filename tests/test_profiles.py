"""Keyed upsert of profiles: one winner per email, nulls and repeats defined, only touched buckets rewritten."""

import os

from modelsieve.operators.notify import profile_merge, upsert_profiles

IN = "email string, username string, display_name string, avatar_url string, provider string, provider_id string, at int"
USERS = "id string, email string, username string, display_name string, avatar_url string, provider string, provider_id string, plan string"


def test_repeats_and_nulls(spark):
    users = spark.createDataFrame([("1", "a@x", "a", "A", None, "github", "p1", "pro"), ("2", None, "n", "N", None, "github", "p2", "free"),
                                   ("3", "d@x", "d", "D", "pic", "github", "p3", "free"), ("4", "d@x", "d2", "D2", None, "github", "p4", "free")], USERS)
    incoming = spark.createDataFrame([("a@x", "", "New", None, "google", "g1", 2), ("a@x", "", "Old", "old", "google", "g0", 1),
                                      ("b@x", None, None, None, "google", "g2", None), ("b@x", "bee", "B", None, "google", "g3", 1),
                                      (None, "z", "Z", None, "google", "g9", 9), ("d@x", "", "", "", "google", "g4", 1), ("d@x", "", "", "", "google", "g4", 1)], IN)
    got = sorted((str(r["email"]), r["username"], r["display_name"], r["avatar_url"], r["provider_id"], r["plan"], r["change"])
                 for r in profile_merge(users, incoming.repartition(3), "at").collect())
    assert got == [("None", "n", "N", None, "p2", "free", "kept"), ("a@x", "a", "New", None, "g1", "pro", "updated"),
                   ("b@x", "bee", "B", None, "g3", "free", "inserted"), ("d@x", "d", "D", "pic", "g4", "free", "updated"),
                   ("d@x", "d2", "D2", None, "g4", "free", "updated")]
    again = [profile_merge(users, incoming.repartition(n)).filter("email = 'b@x'").first()["provider_id"] for n in (1, 4)]
    assert again == ["g3", "g3"]


def test_stored_table_is_rewritten_where_touched(spark, tmp_path):
    path = str(tmp_path / "users")
    rows = [(f"u{k}@x", "", f"U{k}", None, "google", f"g{k}", 1) for k in range(40)]
    upsert_profiles(spark.createDataFrame(rows, IN), path, "at", buckets=8)
    stored = lambda: {os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}
    before = stored()
    change = spark.createDataFrame([("u3@x", "", "Changed", None, "google", "n3", 2), ("u3@x", "", "Older", None, "google", "o3", 1)], IN)
    for _ in range(2):
        upsert_profiles(change, path, "at", buckets=8)
        got = {r["email"]: (r["display_name"], r["provider_id"], r["plan"]) for r in spark.read.parquet(path).collect()}
        assert len(got) == 40 and got["u3@x"] == ("Changed", "n3", "free") and got["u4@x"] == ("U4", "g4", "free")
    assert len(before & stored()) == len(before) - 1
