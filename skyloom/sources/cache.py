"""What sources gave for a region, kept as a keyed table in the shared folder.

A commit is two Parquet folders, its keys with their numbers of rows and the rows, and a manifest that makes both
count; it is written last, under a temporary name, and moved. Of several commits with a key the latest holds (ties of
concurrent writers: the greater name), whole: rows of different commits never mix. A key counts as present only where as
many of its rows are left as its commit had; where files are lost the key is a miss, and the next commit with it heals it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What tells the requests apart; an empty band and epoch for whole catalogs.
REQUEST = "source string, ra double, dec double, radius double, band string, epoch string"
CATALOG = "__catalog__"


def cache_key(source: Column, ra: Column, dec: Column, radius: Column, band: Column, epoch: Column) -> Column:
    """Sixteen hex digits of a request: places to six digits of a degree, radii to four; the epoch only where there is one."""
    raw = F.concat_ws(":", source, F.format_string("%.6f", ra), F.format_string("%.6f", dec), F.format_string("%.4f", radius), F.coalesce(band, F.lit("")), F.when(epoch != "", epoch))
    return F.substring(F.sha2(raw, 256), 1, 16)


def keyed(requests: DataFrame) -> DataFrame:
    """requests with their key; columns that they lack are empty."""
    for c in ("band", "epoch"):
        if c not in requests.columns:
            requests = requests.withColumn(c, F.lit(""))
    return requests.withColumn("key", cache_key(*[F.col(c) for c in ("source", "ra", "dec", "radius", "band", "epoch")]))


class Cache:
    """A cache in a folder that all writers share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def commits(self) -> list[dict]:
        """The manifests, a short list: one for each commit since the last compaction."""
        at = self._path(f"{self.folder}/manifests")
        if not self._files.exists(at):
            return []
        names = [s.getPath() for s in self._files.listStatus(at) if s.getPath().getName().endswith(".json")]
        rows = self.spark.read.text([str(n.toString()) for n in names], wholetext=True).collect() if names else []
        return sorted((json.loads(r.value) for r in rows), key=lambda m: (m["turn"], m["name"]))

    def put(self, name: str, requests: DataFrame, rows: DataFrame) -> None:
        """Commits requests (REQUEST and key) with their rows (key and any columns); a key without rows is kept as empty.

        A commit of the same name that is there already stays as it is, so a writer that is rerun changes nothing.
        """
        done = self.commits()
        if any(m["name"] == name for m in done):
            return
        data = f"{self.folder}/data/{name}-{uuid.uuid4().hex}"
        rows.join(requests.select("key").distinct(), "key", "left_semi").write.parquet(f"{data}/rows")
        counts = self.spark.read.parquet(f"{data}/rows").groupBy("key").agg(F.count("*").alias("n_rows"))
        requests.dropDuplicates(["key"]).join(counts, "key", "left").na.fill(0, ["n_rows"]).write.parquet(f"{data}/keys")
        self._publish({"name": name, "turn": 1 + max((m["turn"] for m in done), default=0), "data": data, "schema": rows.schema.jsonValue()})

    def _publish(self, manifest: dict) -> None:
        draft, last = self._path(f"{self.folder}/drafts/{uuid.uuid4().hex}"), self._path(f"{self.folder}/manifests/{manifest['name']}.json")
        self._files.mkdirs(last.getParent())
        out = self._files.create(draft)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not self._files.rename(draft, last):
            raise OSError(f"cannot publish {last}")

    def _all(self, part: str) -> DataFrame | None:
        """One part of all commits, with the commit's place in their order; files that are gone are left out."""
        out = None
        for place, m in enumerate(self.commits()):
            folder = f"{m['data']}/{part}"
            if not self._files.exists(self._path(folder)) or not self._files.globStatus(self._path(f"{folder}/*.parquet")):
                continue
            own = self.spark.read.option("ignoreMissingFiles", True).parquet(folder).withColumn("_place", F.lit(place))
            out = own if out is None else out.unionByName(own, allowMissingColumns=True)
        return out

    def _live(self) -> tuple[DataFrame, DataFrame | None] | None:
        """Keys whose latest commit is whole, and all rows."""
        keys, rows = self._all("keys"), self._all("rows")
        if keys is None:
            return None
        last = keys.groupBy("key").agg(F.max_by("n_rows", "_place").alias("n_rows"), F.max("_place").alias("_place"))
        if rows is None:
            return last.where("n_rows = 0"), None
        left = rows.groupBy("key", "_place").agg(F.count("*").alias("_left"))
        whole = last.join(left, ["key", "_place"], "left").where(F.coalesce("_left", F.lit(0)) == F.col("n_rows")).drop("_left")
        return whole, rows

    def lookup(self, requests: DataFrame) -> DataFrame:
        """requests with is_hit and n_rows (null for misses)."""
        live = self._live()
        if live is None:
            return requests.withColumn("is_hit", F.lit(False)).withColumn("n_rows", F.lit(None).cast("long"))
        return requests.join(live[0].select("key", "n_rows"), "key", "left").withColumn("is_hit", F.col("n_rows").isNotNull())

    def get(self, requests: DataFrame) -> DataFrame | None:
        """The rows of all requests that are hits; None where nothing is cached."""
        live = self._live()
        if live is None or live[1] is None:
            return None
        whole, rows = live
        wanted = whole.join(requests.select("key").distinct(), "key", "left_semi")
        return rows.join(wanted.select("key", "_place"), ["key", "_place"], "left_semi").drop("_place")

    def compact(self, name: str) -> None:
        """One commit of all that holds in place of those that are there; the old manifests go after the new one is published. No other writer may run meanwhile."""
        old = self.commits()
        live = self._live()
        if live is None or any(m["name"] == name for m in old):
            return
        whole, keys = live[0], self._all("keys")
        requests = keys.join(whole.select("key", "_place"), ["key", "_place"], "left_semi").drop("_place", "n_rows")
        rows = self.get(requests)
        self.put(name, requests, rows if rows is not None else requests.select("key").where("false"))
        for m in old:
            self._files.delete(self._path(f"{self.folder}/manifests/{m['name']}.json"), False)
