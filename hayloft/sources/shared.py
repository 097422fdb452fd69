"""Tables in the folder that driver and executors share; they cut lineage and outlive an executor."""

from __future__ import annotations


def shared_folder(spark) -> str:
    """A new folder that driver and executors share: below ``spark.checkpoint.dir``.

    Where a session on one machine names none (tests), a temporary folder is set
    as the checkpoint folder; on a cluster it must be named.
    """
    import tempfile
    import uuid

    top = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not top:
        set_before = context._jsc.sc().getCheckpointDir()
        if set_before.isDefined():
            top = set_before.get()
        elif context.master.startswith("local"):
            top = "file://" + tempfile.mkdtemp(prefix="hayloft-")
            context.setCheckpointDir(top)
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return f"{top.rstrip('/')}/hayloft-{uuid.uuid4().hex}"


class Scratch:
    """A new folder in the shared space for tables that cut lineage."""

    def __init__(self, spark):
        self.spark, self.folder = spark, shared_folder(spark)

    def write(self, frame, name: str):
        """``frame`` as a table, read again."""
        frame.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(frame.schema).parquet(f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def written(spark, frame, name: str):
    """``frame`` as a table in a new shared folder, read again: cuts the lineage."""
    return Scratch(spark).write(frame, name)
