"""Cutting lineage so that the loss of an executor costs no more than the work since the cut.

Everything goes to the shared folder that the session names in ``spark.checkpoint.dir``. Only where that
setting is missing in a local session, as in tests, a folder of this process is used instead; on a cluster it must be set.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_own: dict[str, str] = {}
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder, set on the context if it is not yet."""
    context = spark.sparkContext
    named = context.getConf().get(_SETTING) or spark.conf.get(_SETTING, None)
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError(f"{_SETTING} must name a folder that all executors share")
        app = context.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="terrane-checkpoint-")
            atexit.register(shutil.rmtree, _own[app], True)
        named = _own[app]
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def checkpointed(df: DataFrame, eager: bool = True) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back.

    Unlike a checkpoint this is columnar and compressed, so it is the better cut for wide intermediate tables.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    _drop_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)  # known, so no job looks for it


def _drop_at_exit(spark: SparkSession, path: str) -> None:
    """What isn't released goes when the driver's JVM ends."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)


#: So many actions run side by side.
SIDE_BY_SIDE = 4


def at_once(*actions: Callable[[], object]) -> list:
    """What the actions return. Their jobs run side by side, so a core that one of them leaves idle works for another."""
    with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(a)) for a in actions]]


def create_once(spark: SparkSession, path: str, data: bytes) -> bool:
    """Makes the file ``path`` with all of ``data`` in one step; False if it is there already.

    A finished draft is renamed onto a name that must be free, which the file system itself refuses otherwise, so of two
    writers one wins. Parent folders are made. Stores without such a rename need a connector that has one.
    """
    context = spark.sparkContext
    jvm, conf = context._jvm, context._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(conf)
    target = files.makeQualified(target)
    draft = jvm.org.apache.hadoop.fs.Path(target.getParent(), f"_draft-{uuid.uuid4().hex}")
    files.mkdirs(target.getParent())
    stream = files.create(draft, False)
    stream.write(bytearray(data))
    stream.close()
    free_name_only = context._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(draft, target, free_name_only)
    except Py4JJavaError as e:
        files.delete(draft, False)
        if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
            return False
        raise
    return True


def read_file(spark: SparkSession, path: str) -> bytes:
    """A small file as a whole."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(target)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def release(spark: SparkSession) -> int:
    """Deletes the tables that :func:`written` made in this process, once their results are stored; returns their number.

    Frames that still read them fail afterwards. Checkpoints are Spark's to clean
    (``spark.cleaner.referenceTracking.cleanCheckpoints``).
    """
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    gone = 0
    while _written:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_written.pop())
        gone += path.getFileSystem(hadoop).delete(path, True)
    return gone
