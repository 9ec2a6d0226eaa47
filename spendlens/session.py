"""Session helpers: a tuned local session for tests/bench and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile

from pyspark.sql import SparkSession

# Settings the engine relies on. AQE re-plans joins from runtime sizes (broadcast
# only when the built side is measured under the threshold), coalesces small
# shuffle partitions and splits skewed join partitions.
ENGINE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.autoBroadcastJoinThreshold": "32m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Python stages (labeller, BPE counter) see texts of up to ~100 KB: keep
    # Arrow batches small enough for worker memory and for fine-grained commits
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    # the labelling job must never run a task twice on purpose
    "spark.speculation": "false",
}


# Runtime SQL settings that a running session can take (the rest of ENGINE_CONF
# must be given at session start).
RUNTIME_CONF = {k: v for k, v in ENGINE_CONF.items() if k.startswith("spark.sql.")}


def configure(spark: SparkSession, overrides: dict | None = None) -> SparkSession:
    """Apply the runtime SQL settings the plans rely on (AQE re-planning, skew-join
    splitting, coalescing) to an existing session, e.g. on a cluster."""
    for k, v in {**RUNTIME_CONF, **(overrides or {})}.items():
        spark.conf.set(k, v)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "spendlens") -> SparkSession:
    """Local session for tests and the benchmark (UI off, no extra ports)."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("SPENDLENS_DRIVER_MEMORY", "16g"))
    )
    for k, v in ENGINE_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for written intermediate tables and stream checkpoints.

    Uses the cluster's ``spark.checkpoint.dir``; only when it is unset (tests,
    local runs) a fresh scratch folder is created and registered.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    sc = _classic_context(spark)
    if not root and sc is not None:
        root = sc.getCheckpointDir()
    if not root:
        if sc is None or not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder; a machine-local one does not survive executor loss")
        root = tempfile.mkdtemp(prefix="spendlens-ckpt-")
        sc.setCheckpointDir(root)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def pin_splits(spark: SparkSession) -> None:
    """Files are cut into the same splits whenever this session reads them. Unless told,
    Spark cuts them by the number of cores that there are at the moment."""
    name = "spark.sql.files.minPartitionNum"
    if spark.conf.get(name, None) is None:
        sc = _classic_context(spark)
        cores = spark.conf.get("spark.sql.leafNodeDefaultParallelism", None)
        spark.conf.set(name, str(cores or (sc.defaultParallelism if sc is not None else 200)))


def _classic_context(spark: SparkSession):
    """The SparkContext of a classic session; None for a Spark Connect session."""
    try:
        return spark.sparkContext
    except Exception:  # noqa: BLE001 - Connect sessions have no SparkContext
        return None


def work_path(spark: SparkSession, name: str) -> str:
    """A new, unique folder under the checkpoint root (never reused, never cleared)."""
    return f"{checkpoint_root(spark)}/spendlens/{name}-{uuid.uuid4().hex[:12]}"


_SHIPPED: set[str] = set()
_SHIP_LOCK = threading.Lock()


def ship_package(spark: SparkSession) -> None:
    """Make ``spendlens`` importable in the Python workers (the ``--py-files``
    mechanism at runtime): zip the package once per application and add it with
    ``addPyFile``; Spark distributes it to every executor."""
    sc = _classic_context(spark)
    app = sc.applicationId if sc is not None else f"connect-{spark.session_id}"
    with _SHIP_LOCK:
        if app in _SHIPPED:
            return
        pkg = os.path.dirname(os.path.abspath(__file__))
        root = os.path.dirname(pkg)
        fd, path = tempfile.mkstemp(prefix="spendlens-", suffix=".zip")
        os.close(fd)
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for dirpath, _, files in os.walk(pkg):
                for f in files:
                    if f.endswith(".py"):
                        full = os.path.join(dirpath, f)
                        z.write(full, os.path.relpath(full, root))
        if sc is not None:
            sc.addPyFile(path)
        else:
            spark.addArtifacts(path, pyfile=True)
        _SHIPPED.add(app)
