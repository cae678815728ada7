"""What the operators of this subpackage share: tables, shared folders, sizes, hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..session import ship_package

#: Rows and bytes in an Arrow batch; texts can be long, so few rows.
ARROW_ROWS, ARROW_BYTES = 128, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of an input folder, by Spark's own reader (any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the Python stages that this session runs from now on, and give them this code."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder's URI below the cluster's shared folder (``spark.checkpoint.dir``).

    Where that setting is absent in a local session, as in tests, a temporary folder becomes the checkpoint folder;
    on a cluster it is an error. What operators write there (``token-shards-*``, ``pipeline-*`` and checkpoints) is
    read after they return, so it is the caller's to remove.
    """
    ensure_checkpoint_dir(spark)
    base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """``checkpoint()`` works after this call; a set ``spark.checkpoint.dir`` is never replaced."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set")
        sc.setCheckpointDir(named or f"file://{tempfile.mkdtemp(prefix='locusframe-')}")


def cut(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Cut the lineage in the shared folder: the rows are computed once and survive lost executors.

    What is cut is small beside the documents, so one file for each core (or ``parts`` files) will do.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.coalesce(parts or df.sparkSession.sparkContext.defaultParallelism).checkpoint(eager=True)


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI; Hadoop's ``file:/x`` form is accepted."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)


def parts_for(df: DataFrame, mb: float, least: int = 1) -> int:
    """Partitions so that each gets about ``mb`` MB of what the plan reads, by the plan's own estimate.

    Only the plan's leaves count: estimates above joins multiply. Leaves of unknown size count as nothing.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    return max(least, -(-sum(n for n in sizes if n < 1 << 50) // int(mb * 1e6)))


def chunks(texts: Sequence[str | None], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """(first, end) of neighbouring texts of about ``most`` characters together; a longer one is alone."""
    first = held = 0
    for k, t in enumerate(texts):
        n = len(t) if t else 0
        if k > first and held + n > most:
            yield first, k
            first, held = k, 0
        held += n
    if first < len(texts):
        yield first, len(texts)


_MULT1 = np.uint64(0xBF58476D1CE4E5B9)
_MULT2 = np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser on an array of uint64: a bijection that spreads all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MULT1
    x = x ^ (x >> np.uint64(27))
    x = x * _MULT2
    return x ^ (x >> np.uint64(31))


def utf8(text: str | None) -> bytes:
    """A text's bytes; null is the empty text."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def pack40(values: np.ndarray) -> bytes:
    """The lower 40 bits of each uint64."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def unpack40(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel().astype(np.uint64)
