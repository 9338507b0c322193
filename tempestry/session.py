"""Session, table access, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if the optimizer's own estimate of it stays below this.
BROADCAST_LIMIT = 16 * 1024 * 1024


def build_session(app: str = "tempestry", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC times, AQE and Arrow; conf overrides single settings."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    return b.config(map=base | conf).getOrCreate()


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The parquet table `name` under `root`."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's spark.checkpoint.dir; only a master in this one process may fall back to a temporary folder
    (local-cluster has executors of its own and may not)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="tempestry-")
    sc.setCheckpointDir(shared)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, kind: str = "tables") -> str:
    """A new path in the shared folder; what is written there is deleted when the program ends."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{kind}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  (the session is gone: the folder is its owner's to clear)
        return


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: cuts the lineage, is computed once however often it is used, keeps the
    columns apart (later reads are pruned) and has a known size."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file at any path that Hadoop's file systems know."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def put_pieces(spark: SparkSession, path: str, pieces: list[tuple[str, str]]) -> None:
    """A text file of any size: of each (text, folder) the text, then the files that Spark wrote to the folder, in their order. They are
    copied through a small buffer, so the driver never holds them, and each is deleted at once, so the disk doesn't hold all of it twice."""
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    name = lambda f: f.rsplit("/", 1)[1]
    p = hadoop.fs.Path(path)
    out = p.getFileSystem(conf).create(p, True)
    try:
        for text, folder in pieces:
            out.write(bytearray(text.encode()))
            parts = [f for f in list_files(spark, folder) if name(f).startswith("part-")]
            for f in sorted(parts, key=lambda f: int(name(f).split("-")[1])):  # by task: names sort only up to five digits
                q = hadoop.fs.Path(f)
                part = q.getFileSystem(conf).open(q)
                try:
                    hadoop.io.IOUtils.copyBytes(part, out, 65_536, False)
                finally:
                    part.close()
                _delete(spark, f)
    finally:
        out.close()
    for _, folder in pieces:
        _delete(spark, folder)


def get_text(spark: SparkSession, path: str) -> str:
    """What put_text wrote."""
    return spark.read.text(path, wholetext=True).first()[0]


def rename(spark: SparkSession, old: str, new: str) -> None:
    """Move a file, making the folder it goes to."""
    a, b = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (old, new))
    fs = a.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(b.getParent())
    if not fs.rename(a, b):
        raise OSError(f"can't move {old} to {new}")


def list_files(spark: SparkSession, folder: str) -> list[str]:
    """The full paths of the files and folders right under a folder of any file system, sorted; none if it isn't there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(str(s.getPath().toString()) for s in fs.listStatus(p)) if fs.exists(p) else []


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of df (file sizes carried through the plan)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """df with a broadcast hint if its estimated size is under the limit, else df as it is (the planner then shuffles)."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, wherever the driver found it: once per application it goes to them as a
    zip file. Every operator that runs Python functions calls this first."""
    sc = spark.sparkContext
    if getattr(sc, "_tempestry_shipped", False):
        return
    home = Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory(prefix="tempestry-", delete=False) as folder:
        target = f"{folder}/tempestry.zip"
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted(home.rglob("*.py")):
                z.write(f, f"{home.name}/{f.relative_to(home)}")
        sc.addPyFile(target)
    sc._tempestry_shipped = True
