"""Session defaults and the shared working folder."""

from __future__ import annotations

import atexit
import logging
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import SparkSession

log = logging.getLogger(__name__)

_AREAS: set[str] = set()
_FALLBACKS: dict[str, str] = {}  # per application: the core setting can't be changed at run time


def local_session(cores: str = "8", app: str = "gridledger", **conf: str) -> SparkSession:
    """A single-machine session for tests and the bench. Clusters bring their own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a single-machine session may go without that setting; it then gets a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if spark.sparkContext.master.startswith("local-cluster") or not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    application = spark.sparkContext.applicationId
    if application not in _FALLBACKS:
        _FALLBACKS[application] = tempfile.mkdtemp(prefix="gridledger-")
    return _FALLBACKS[application]


def new_work_path(spark: SparkSession, label: str) -> str:
    """A fresh, unused path below the application's own part of the shared folder.

    What lies there backs results that are still to be read, so it stays until the program ends.
    """
    area = f"{shared_root(spark)}/gridledger/{spark.sparkContext.applicationId}"
    _AREAS.add(area)
    return f"{area}/{label}-{uuid.uuid4().hex}"


@atexit.register
def remove_work_areas() -> None:
    """Delete what this program staged. A killed driver leaves its area, named by its application id."""
    gateway = SparkContext._gateway
    while _AREAS and gateway is not None:
        area = _AREAS.pop()
        try:
            path = gateway.jvm.org.apache.hadoop.fs.Path(area)
            path.getFileSystem(gateway.jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)
        except Exception as err:
            log.warning("work area %s remains: %s", area, str(err).splitlines()[0])


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable, keeping a folder the session already has."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_root(spark))
