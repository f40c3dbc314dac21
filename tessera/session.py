"""Session construction and cluster-safe checkpoint handling."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every tessera job relies on.  AQE re-plans joins from runtime sizes
# (so a join side is only broadcast after its real size is known to be under
# ``autoBroadcastJoinThreshold``), coalesces small shuffle partitions and splits
# skewed ones.  UTC keeps date arithmetic identical on every executor.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # remove reliable-checkpoint files once their DataFrame is garbage collected
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(app: str = "tessera", master: str | None = None,
              shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """Build (or reuse) a session with tessera's defaults.

    ``master`` is only set when given: on a cluster the launcher decides it.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = dict(_DEFAULTS)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, configuring one only for local runs.

    On a cluster ``spark.checkpoint.dir`` must name a shared file system that
    survives executor loss; we read it from the session and never invent a
    machine-local one.  In local mode (tests) an unset value gets a fresh
    temporary folder.
    """
    # setCheckpointDir adds a subfolder of its own each time, so it is called once
    active, configured = spark.sparkContext.getCheckpointDir(), spark.conf.get("spark.checkpoint.dir", None)
    if active or configured:
        if not active:
            spark.sparkContext.setCheckpointDir(configured)
        return active or configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; point it at a shared folder")
    path = tempfile.mkdtemp(prefix="tessera-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.sparkContext.setCheckpointDir(path)
    return path


def cut_lineage(df):
    """Reliable checkpoint (never ``localCheckpoint``): survives executor loss."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tessera`` importable in Python workers.

    Pandas UDFs and ``mapInPandas`` functions are pickled by module reference;
    executors (and local workers started elsewhere) do not share the driver's
    ``sys.path``.  The package is zipped once per application and distributed
    with ``addPyFile``, Spark's standard way of shipping Python code.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    import shutil
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    # The archive only lives on the driver: addPyFile uploads it to every executor
    # through Spark's file server.  It holds code, never job data or checkpoints.
    out = tempfile.mkdtemp(prefix="tessera-pyfiles-")
    archive = shutil.make_archive(os.path.join(out, "tessera"), "zip", os.path.dirname(pkg_dir), "tessera")
    sc.addPyFile(archive)
    _SHIPPED.add(app)


def cluster_conf(input_bytes: int, cores: int, partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Settings for a large run, sized from the input volume.

    Shuffle partitions start at about one per ``partition_bytes`` of input (at
    least 2x the cores) and AQE coalesces the small ones and splits skewed
    ones at run time.  Broadcasts stay behind AQE's measured-size threshold.
    ``spark.checkpoint.dir`` must be added by the caller: a shared folder.
    """
    shuffle = max(2 * cores, -(-input_bytes // partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes // 2),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.session.timeZone": "UTC",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
