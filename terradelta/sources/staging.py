"""Tables that cut lineage: written to the folder that driver and executors share, and read back."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_made: dict[str, list[str]] = {}


def whole_unions(spark: SparkSession) -> None:
    """Spark 4.1 deals a union's parts together by partition if they are hashed alike; where adaptive execution has cut these
    differently, rows of a part are lost (a union of a sort-merge join and of what a repartition by its key gave lost
    the second). Without that setting a union is all its parts. For the session; to be called before a plan is run."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, an own temporary one on a local master (tests);
    on a cluster executors would not see that, so there it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="terradelta-")
    return _own[app]


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here, and a lost executor
    costs nothing that was finished. Unlike checkpoint() it computes the plan once."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stages(spark: SparkSession, since: int = 0) -> None:
    """Remove the paths that this application made in the shared folder, from number ``since`` on: what was computed
    from them must have been written elsewhere."""
    made = _made.get(spark.sparkContext.applicationId, [])
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    while len(made) > since:
        path = jvm.org.apache.hadoop.fs.Path(made.pop())
        path.getFileSystem(conf).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside go at the end, whatever happens: the result must be written by then."""
    before = len(_made.get(spark.sparkContext.applicationId, []))
    try:
        yield
    finally:
        drop_stages(spark, before)
