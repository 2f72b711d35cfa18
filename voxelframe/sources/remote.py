"""Volumes on an HTTP server: a table of requests becomes a table of answers, and a cache in the shared store keeps them."""

from __future__ import annotations

import base64
import time
import urllib.error
import urllib.request
import uuid
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import cache_name, tile_path
from ..operators.sample import ChunkPyramid, Edges
from . import volumes

BUSY = 420


def basic(user: str, password: str) -> str:
    """The value of an Authorization header."""
    return "Basic " + base64.b64encode(f"{user}:{password}".encode()).decode()


def get(url: str, authorization: str | None = None, retries: int = 20, wait: float = 10.0, timeout: float = 60.0) -> tuple[int, bytes | None]:
    """Status and body: asked again after `wait` seconds while the server is busy, `retries` times; 0 if it can't be reached."""
    request = urllib.request.Request(url, headers={"Authorization": authorization} if authorization else {})
    for left in range(retries, -1, -1):
        try:
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                return answer.status, answer.read()
        except urllib.error.HTTPError as e:
            if e.code != BUSY or not left:
                return e.code, None
        except (urllib.error.URLError, OSError):
            return 0, None
        time.sleep(wait)
    return BUSY, None


def is_authorized(url: str, authorization: str | None = None) -> bool:
    return get(url, authorization, retries=0)[0] == 200


def cached_file(spark: SparkSession, url: str, cache: str, authorization: str | None = None, timeout: float = 60.0) -> str:
    """Where the file of a URL lies in a cache that all executors share; fetched if it is not there yet.

    It is written beside its place a few megabytes at a time and then moved, so a broken transfer leaves no part.
    Raises ValueError if the server does not have it.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    name = spark.range(1).select(cache_name(F.lit(url)).alias("n")).first().n
    place = jvm.org.apache.hadoop.fs.Path(f"{cache.rstrip('/')}/files/{name}/{url.rstrip('/').rsplit('/', 1)[-1]}")
    store = place.getFileSystem(conf)
    if store.exists(place):
        return place.toString()
    part = place.suffix(f".{uuid.uuid4().hex}")
    request = urllib.request.Request(url, headers={"Authorization": authorization} if authorization else {})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            out = store.create(part)
            while body := answer.read(4 << 20):
                out.write(bytearray(body))
            out.close()
    except (urllib.error.URLError, OSError) as e:
        store.delete(part, False)
        raise ValueError(f"no file at {url}: {e}") from e
    store.rename(part, place)
    return place.toString()


def fetch(requests: DataFrame, url_col: str = "url", concurrency: int = 32, authorization: str | None = None, retries: int = 20, wait: float = 10.0) -> DataFrame:
    """`requests` with status, state (Done, Delayed or Failed) and data.  Each distinct URL is asked for once, by `concurrency` tasks at most.

    Write the result with `store`; a lost task asks for its own URLs again and nothing else.
    """
    todo = requests.select(F.col(url_col).alias("url")).distinct().repartition(concurrency, "url")

    def ask(batches):
        for batch in batches:
            for u in batch["url"].to_pylist():
                status, body = get(u, authorization, retries, wait) if u is not None else (0, None)
                state = "Done" if status == 200 else "Delayed" if status == BUSY else "Failed"
                yield pa.RecordBatch.from_pylist([{"url": u, "status": status, "state": state, "data": body}], schema=pa.schema([("url", pa.string()), ("status", pa.int32()), ("state", pa.string()), ("data", pa.binary())]))

    got = todo.mapInArrow(ask, "url string, status int, state string, data binary").withColumnRenamed("url", url_col)
    return requests.join(got, url_col, "left")


def store(answers: DataFrame, path: str, keys: list[str]) -> None:
    """Answers as a chunk table partitioned by level: a commit is all or nothing, and misses keep a row without data."""
    answers.select(*keys, "state", "data").write.mode("append").partitionBy("level").parquet(path)


KEYS = ["level", "cx", "cy", "cz"]
REPORT_DDL = "state string, n bigint, bytes bigint"
CACHE_DDL = "level INT, cx BIGINT, cy BIGINT, cz BIGINT, state STRING, data BINARY"


@dataclass
class RemoteVolume:
    """A volume behind a URL, read through a cache: what is asked for and not known is fetched, once.

    `cache` is a folder in a store that all executors share; a volume has a table of its own in it, with a row for
    each chunk that came (Done) or that the server does not have (Failed).  Chunks that the server was too busy for,
    or that could not be asked for, have no row and are asked for again.
    """

    spark: SparkSession
    url: str
    kind: str
    cache: str
    authorization: str | None = None
    concurrency: int = 32
    retries: int = 20
    wait: float = 10.0
    arrays: list[tuple[str, dict]] = field(default_factory=list)  # place and definition of each level; none for tiles

    @classmethod
    def open(cls, spark: SparkSession, url: str, cache: str, kind: str | None = None, authorization: str | None = None, **how) -> RemoteVolume:
        """Finds the format by the metadata files on the server where `kind` is not given."""
        url = url.rstrip("/")
        has = lambda name: volumes.metadata(spark, f"{url}/{name}", authorization) is not None
        kind = kind or ("ome" if has(".zattrs") else "zarr" if has(".zarray") else "tiles")
        places = volumes.pyramid_paths(spark, url, authorization=authorization) if kind == "ome" else [url] if kind == "zarr" else []
        name = spark.range(1).select(cache_name(F.lit(url)).alias("n")).first().n
        return cls(spark, url, kind, f"{cache.rstrip('/')}/{name}", authorization, arrays=[(p, volumes.array_definition(spark, p, authorization)) for p in places], **how)

    @property
    def edges(self) -> tuple[Edges, ...]:
        return tuple(volumes.edges(d) for _, d in self.arrays) or (64,)

    def urls(self) -> Column:
        """The URL of a chunk (level, cx, cy, cz)."""
        if not self.arrays:
            return F.concat(F.lit(f"{self.url}/"), tile_path(F.col("cx").cast("int"), F.col("cy").cast("int"), F.col("cz").cast("int"), F.call_function("shiftleft", F.lit(1), F.col("level"))))
        out = F.lit(None).cast("string")
        for level, (place, d) in enumerate(self.arrays):
            out = F.when(F.col("level") == level, F.concat(F.lit(f"{place}/"), F.concat_ws(d["dimension_separator"] or ".", "cz", "cy", "cx"))).otherwise(out)
        return out

    def known(self) -> DataFrame:
        """The cache: level, cx, cy, cz, state and data as the server sent it."""
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(self.cache)
        if not place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            return self.spark.createDataFrame([], CACHE_DDL)
        return self.spark.read.schema(CACHE_DDL).parquet(self.cache)

    def fetch(self, keys: DataFrame, again: bool = False) -> DataFrame:
        """Fetches the wanted chunks (level, cx, cy, cz) that are not known; with `again`, also those the server did not have.

        Returns (state, n, bytes) of the requests made.
        """
        known = self.known().where("state = 'Done'") if again else self.known()
        todo = keys.select(*KEYS).distinct().join(known.select(*KEYS), KEYS, "left_anti").withColumn("url", self.urls())
        answers = fetch(todo, "url", self.concurrency, self.authorization, self.retries, self.wait)
        todo = todo.persist() if not todo.isEmpty() else None
        if todo is None:
            return self.spark.createDataFrame([(s, 0, 0) for s in ("Done", "Delayed", "Failed")], REPORT_DDL)
        seen = Observation()
        parts = {s: (F.col("state") == s) for s in ("Done", "Delayed", "Failed")}
        marks = [F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(s) for s, c in parts.items()]
        answers = answers.observe(seen, *marks, F.coalesce(F.sum(F.length("data")), F.lit(0)).alias("bytes"))
        store(answers.where("state = 'Done' or (state = 'Failed' and status <> 0)"), self.cache, KEYS)
        got = seen.get
        todo.unpersist()
        return self.spark.createDataFrame([(s, int(got[s]), int(got["bytes"]) if s == "Done" else 0) for s in parts], REPORT_DDL)

    def chunks(self, keys: DataFrame) -> DataFrame:
        """The wanted chunks (level, cx, cy, cz, data) that there are, decoded; unknown ones are fetched first."""
        self.fetch(keys)
        rows = self.known().where("state = 'Done'").join(keys.select(*KEYS).distinct(), KEYS, "left_semi").dropDuplicates(KEYS)
        if not self.arrays:
            return rows.select(*KEYS, volumes.straightened(F.col("data")).alias("data")).where("data is not null")
        packed = [level for level, (_, d) in enumerate(self.arrays) if d["compressor"]]
        plain = rows.where(~F.col("level").isin(packed)) if packed else rows
        out = plain.select(*KEYS, "data")
        if packed:
            out = out.unionByName(rows.where(F.col("level").isin(packed)).select(*KEYS, volumes.decode_chunks(F.col("data"), True).alias("data")))
        return out

    def pyramid(self) -> ChunkPyramid:
        """The volume for sampling: each level's missing chunks are fetched for the points that ask it."""
        return ChunkPyramid(None, self.edges, source=self.chunks)
