"""Tables whose rows count once a ledger names them: a try that dies, a second try and a second writer add nothing.

A commit stages its files in a folder of its own and then creates the next numbered entry of the ledger. That an entry can be created
by one writer only orders all commits; whoever loses reads what was committed before it and tries again. Files that no entry names are
never read. An entry is a small line for each (query, batch), so the driver reads as many lines as there are batches, not rows.
Local files and HDFS create entries atomically; an object store must have a committer that does.
"""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import keep_first
from ..session import cut

ENTRY = "query string, batch string, attempt string, tables array<string>, n bigint"
#: The folder of one try.
ATTEMPT = "tidemark_try"


def entries(spark: SparkSession, root: str) -> list[dict]:
    """The committed (query, batch), in order of commitment."""
    from pyspark.errors import AnalysisException

    try:
        lines = spark.read.schema(ENTRY).json(f"{root}/ledger/*.json").collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted((r.asDict() for r in lines), key=lambda r: r["n"])


def _local(spark: SparkSession, path: str) -> str | None:
    """The path as a local one, if it is local."""
    scheme = urlparse(path).scheme or urlparse(spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS")).scheme
    return urlparse(path).path if scheme == "file" else None


def moved(spark: SparkSession, source: str, target: str) -> bool:
    """Rename where the target is not there; gives whether it was not. Hadoop's file systems make it one step."""
    jvm = spark._jvm
    fs = jvm.org.apache.hadoop.fs
    context = fs.FileContext.getFileContext(fs.Path(target).toUri() if urlparse(target).scheme else fs.Path(f"file:{target}").toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0)
    try:
        context.rename(fs.Path(source), fs.Path(target), none)
    except Exception as e:
        if "FileAlreadyExists" not in str(e):
            raise
        return False
    return True


def _created(spark: SparkSession, path: str, text: str) -> bool:
    """Create the file, whole, unless there is one; gives whether this call did."""
    draft = f"{os.path.dirname(path)}/.{uuid.uuid4().hex}"  # hidden, so that it is no entry
    here = _local(spark, path)
    if here:
        draft = _local(spark, draft)
        os.makedirs(os.path.dirname(here), exist_ok=True)
        with open(draft, "w") as f:
            f.write(text)
        try:
            os.link(draft, here)
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
        return True
    fs = spark._jvm.org.apache.hadoop.fs
    system = fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = system.create(fs.Path(draft), True)
    out.write(bytearray(text.encode()))
    out.close()
    won = moved(spark, draft, path)
    if not won:
        system.delete(fs.Path(draft), False)
    return won


def _commit(spark: SparkSession, root: str, query: str, batch: str, tables: dict[str, DataFrame], before: list[dict], within: str | None = None) -> bool:
    """Stage the tables and try to be the entry after `before`."""
    attempt = uuid.uuid4().hex
    for name, df in tables.items():
        writer = df.write.partitionBy(within) if within else df.write
        writer.parquet(f"{root}/data/{name}/{ATTEMPT}={attempt}")
    entry = {"query": query, "batch": batch, "attempt": attempt, "tables": list(tables), "n": len(before)}
    return _created(spark, f"{root}/ledger/{len(before):012d}.json", json.dumps(entry))


def commit(root: str, query: str, batch: str, tables: dict[str, DataFrame]) -> bool:
    """Publish the tables of a batch together, once for (query, batch); gives whether this call did. All or none can be read."""
    spark = next(iter(tables.values())).sparkSession
    while True:
        before = entries(spark, root)
        if any((e["query"], e["batch"]) == (query, batch) for e in before):
            return False
        if _commit(spark, root, query, batch, tables, before):
            return True


def read(spark: SparkSession, root: str, name: str, schema, known: list[dict] | None = None) -> DataFrame:
    """The committed rows of a table; none if nothing has been committed."""
    found = [f"{root}/data/{name}/{ATTEMPT}={e['attempt']}" for e in (entries(spark, root) if known is None else known) if name in e["tables"]]
    if not found:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{root}/data/{name}").parquet(*found).drop(ATTEMPT)


def insert(new: DataFrame, root: str, name: str, keys: list[str], query: str, batch: str, *order: Column | str, within: str | None = None) -> int:
    """Add the rows whose keys are not committed, each key once, as (query, batch); gives how many. Null is a key like another.

    Two writers at once never both add a key: the second to commit meets the first's rows and leaves them out. Of several new rows of a
    key the first in the order is taken, else the first by the hash of all its columns. within: one of the keys, by whose values files
    lie; then only the stored rows of values that `new` has are read.
    """
    spark = new.sparkSession
    first = keep_first(new, keys, *(order or [F.xxhash64(*new.columns)]))
    staged = cut(first, "insert")  # read again where another writer was first
    touched = [r[0] for r in staged.select(within).distinct().collect()] if within else []  # batches or days of one insert
    while True:
        before = entries(spark, root)
        if any((e["query"], e["batch"]) == (query, batch) for e in before):
            return 0
        stored = read(spark, root, name, new.schema, before)
        if within:
            some = F.col(within).isin([x for x in touched if x is not None])
            stored = stored.where(some | F.col(within).isNull() if None in touched else some)
        renamed = stored.select(*[F.col(k).alias(f"_{k}") for k in keys])
        same = None
        for k in keys:
            one = F.col(k).eqNullSafe(F.col(f"_{k}"))
            same = one if same is None else same & one
        fresh = cut(staged.join(renamed, same, "left_anti"), "fresh")
        if _commit(spark, root, query, batch, {name: fresh}, before, within):
            return fresh.count()


def sink(root: str, name: str, keys: list[str], query: str, within: str | None = None):
    """For `foreachBatch`: each micro-batch is inserted once, however often it is tried."""

    def write(df: DataFrame, batch: int) -> None:
        insert(df, root, name, keys, query, str(batch), within=within)

    return write
