"""Where derived tables live.

A library is a folder with a subfolder for every part of its tables and numbered
pointer files. A pointer names the parts of each table; it is written once and
never changed, and the highest complete one is the library. Writers add parts
and then the next pointer; readers keep the one they opened, and a crash at any
moment leaves the last one in force. Two writers can't take the same number, so
the later one fails and its parts stay unused.

Derived tables (edges, scores) carry the parts of the index that they were made
from, so a changed index makes them absent at once.
"""

from __future__ import annotations

import gc
import json
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOOKS = T.StructType([T.StructField(n, t) for n, t in (("id", T.LongType()), ("title", T.StringType()), ("author", T.StringType()), ("source", T.StringType()), ("words", T.LongType()), ("digest", T.StringType()), ("excerpt", T.StringType()))])
POSTINGS = T.StructType([T.StructField("word", T.StringType()), T.StructField("book_id", T.LongType()), T.StructField("count", T.LongType())])
TERMS = T.StructType([T.StructField("word", T.StringType())])
EDGES = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("similarity", T.DoubleType())])
SCORES = T.StructType([T.StructField("book_id", T.LongType()), T.StructField("score", T.DoubleType())])
SCHEMAS = {"books": BOOKS, "terms": TERMS, "postings": POSTINGS, "edges": EDGES, "scores": SCORES}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the checkpoint folder that the session was given
    later; without one only a session on one machine goes on."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = known.get() if known.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder that driver and executors share.")
        base = "file://" + tempfile.mkdtemp(prefix="lexigraph-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def saved(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def swept(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished jobs: Spark removes those whose
    plans the driver has collected, which it else does now and then."""
    for _ in range(2):  # a job's last event may still hold its plan
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


#: Pointers that are kept for readers that opened them.
KEPT_POINTERS = 20


class Store:
    """The versioned tables of one library."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._place = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._place(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        """Numbers of the pointer files, the highest first."""
        folder = self._place(f"{self.path}/pointers")
        if not self._files.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._files.listStatus(folder)]
        return sorted((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), reverse=True)

    def _where(self, number: int):
        return self._place(f"{self.path}/pointers/{number:012d}.json")

    def pointer(self) -> dict:
        """Parts of the tables and the graph's metadata, {} at first. No Spark
        job: a listing and one small file."""
        for number in self._numbers():
            stream = self._files.open(self._where(number))
            try:
                text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            try:
                return json.loads(text)
            except ValueError:
                continue  # its writer was lost before the end
        return {}

    def point(self, to: dict) -> None:
        """Make ``to`` the next pointer."""
        numbers = self._numbers()
        number = numbers[0] + 1 if numbers else 1
        stream = self._files.create(self._where(number), False)
        stream.write(json.dumps(to, sort_keys=True).encode())
        stream.close()
        for old in numbers[KEPT_POINTERS:]:
            self._files.delete(self._where(old), False)

    def write(self, df: DataFrame, name: str) -> str:
        """A new part of a table; it doesn't count until ``point``."""
        part = f"{name}/{uuid.uuid4().hex}"
        fields = SCHEMAS[name].fields
        df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in fields)).write.parquet(f"{self.path}/{part}")
        return part

    def read(self, name: str, at: dict | None = None) -> DataFrame:
        """A table's current parts as one; an empty one where there is none."""
        at = self.pointer() if at is None else at
        if not at.get(name) or name in ("edges", "scores") and not self.graph(at):
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(*(f"{self.path}/{part}" for part in at[name]))

    def graph(self, at: dict | None = None) -> dict | None:
        """Metadata of the graph, if it was made from the present index."""
        at = self.pointer() if at is None else at
        found = at.get("graph")
        return found if found and at.get("graph_of") == at.get("postings") else None
