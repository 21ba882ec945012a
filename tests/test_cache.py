"""The cache: hits and misses, upserts, reruns, two writers, lost files."""

import glob
import os

from pyspark.sql import functions as F

from skyloom.sources.cache import Cache, keyed


def requests(spark, *places):
    return keyed(spark.createDataFrame([("s", float(p), 0.5, 3.0) for p in places], "source string, ra double, dec double, radius double"))


def rows(req, n, tag):
    return req.select("key", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("i"), F.lit(tag).alias("tag"))


def hits(cache, req):
    return {r.ra: r.n_rows for r in cache.lookup(req).collect() if r.is_hit}


def test_key(spark):
    import hashlib

    own = spark.createDataFrame([("sdss", 10.5, -3.25, 3.0, "g", "2020"), ("sdss", 10.5, -3.25, 3.0, "", "")], "source string, ra double, dec double, radius double, band string, epoch string")
    want = [hashlib.sha256(t.encode()).hexdigest()[:16] for t in ("sdss:10.500000:-3.250000:3.0000:g:2020", "sdss:10.500000:-3.250000:3.0000:")]
    assert [r.key for r in keyed(own).collect()] == want


def test_cache(spark, tmp_path):
    folder = f"file://{tmp_path}/cache"
    cache = Cache(spark, folder)
    every = requests(spark, 1, 2, 3, 4)
    assert hits(cache, every) == {} and cache.get(every) is None
    one = requests(spark, 1, 2)
    cache.put("first", one, rows(one, 3, "old"))
    empty = requests(spark, 3)
    cache.put("empty", empty, rows(empty, 1, "x").where("false"))
    assert hits(cache, every) == {1.0: 3, 2.0: 3, 3.0: 0}
    cache.put("first", one, rows(one, 9, "rerun"))  # a rerun changes nothing
    assert hits(cache, every) == {1.0: 3, 2.0: 3, 3.0: 0}
    two = requests(spark, 2, 4)
    Cache(spark, folder).put("second", two, rows(two, 2, "new"))  # another writer
    assert hits(cache, every) == {1.0: 3, 2.0: 2, 3.0: 0, 4.0: 2}
    assert sorted((r.tag, r.i) for r in cache.get(requests(spark, 2)).collect()) == [("new", 1), ("new", 2)]
    cache.compact("all")
    assert [m["name"] for m in cache.commits()] == ["all"]
    assert hits(cache, every) == {1.0: 3, 2.0: 2, 3.0: 0, 4.0: 2}


def test_two_writers_of_one_turn(spark, tmp_path):
    cache, own = Cache(spark, f"file://{tmp_path}/cache"), requests(spark, 1)
    cache.put("a", own, rows(own, 1, "a"))
    other = Cache(spark, f"file://{tmp_path}/cache")
    other.commits = lambda: []  # saw nothing of the first
    other.put("b", own, rows(own, 2, "b"))
    assert hits(cache, own) == {1.0: 2} and {r.tag for r in cache.get(own).collect()} == {"b"}


def test_lost_file_heals(spark, tmp_path):
    cache, own = Cache(spark, f"file://{tmp_path}/cache"), requests(spark, 1, 2, 3, 4, 5, 6, 7, 8)
    cache.put("a", own, rows(own, 2, "a").repartition(4, "key", "i"))
    assert len(hits(cache, own)) == 8
    lost = max(glob.glob(f"{tmp_path}/cache/data/a-*/rows/*.parquet"), key=os.path.getsize)
    gone = {r.key for r in spark.read.parquet(lost).collect()}
    os.remove(lost)
    assert gone and {r.key for r in cache.lookup(own).where("not is_hit").collect()} == gone
    assert not gone & {r.key for r in cache.get(own).collect()}
    missing = cache.lookup(own).where("not is_hit").drop("is_hit", "n_rows")
    cache.put("b", missing, rows(missing, 2, "b"))
    assert len(hits(cache, own)) == 8
