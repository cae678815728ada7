"""What a session needs before Python stages of this package can run on executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent


def ship_package(spark: SparkSession) -> None:
    """Send this package's source to the executors, once a session; workers import it from there.

    Sessions whose workers have the package on their path already lose nothing: both are the same code.
    """
    sc = spark.sparkContext
    if getattr(sc, "_locusframe_shipped", False) or str(_ROOT.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    folder = tempfile.mkdtemp(prefix="locusframe-code-")
    path = os.path.join(folder, "locusframe_code.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(_ROOT.rglob("*.py")):
            z.write(f, f.relative_to(_ROOT.parent))
    sc.addPyFile(path)
    sc._locusframe_shipped = True


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder's URI in the session's shared folder, ``spark.checkpoint.dir``; files there are the caller's to remove.

    Where that setting is absent a temporary folder takes its place, which only a local session can share; on a
    cluster its absence is an error.
    """
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set")
        base = f"file://{tempfile.mkdtemp(prefix='locusframe-files-')}"
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def register_functions(spark: SparkSession) -> None:
    """SQL functions over the kernels: tree topologies, rerooting, leaves, tiles and charsets."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    from .operators import trees
    from .sources.alignment import parse_charsets

    ship_package(spark)

    @F.pandas_udf("string")
    def tree_topology(newick, outgroup):
        return newick.combine(outgroup, trees.topology_key)

    @F.pandas_udf("string")
    def tree_reroot(newick, leaf):
        return newick.combine(leaf, lambda t, x: trees.write_tree(trees.reroot(trees.parse_tree(t), x)))

    @F.pandas_udf("array<string>")
    def tree_leaves(newick):
        return newick.map(lambda t: sorted(trees.leaves(trees.parse_tree(t))))

    @F.udtf(returnType="k int, start long, end long")
    class FlushTiles:
        def eval(self, length: int, probe: int, stride: int):
            for k, start in enumerate(range(0, length, stride)):
                yield k + 1, start, start + probe

    @F.udtf(returnType=T.StructType([T.StructField("name", T.StringType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
    class Charsets:
        def eval(self, text: str):
            yield from parse_charsets(text)

    for f in (tree_topology, tree_reroot, tree_leaves):
        spark.udf.register(f.__name__, f)
    spark.udtf.register("flush_tiles", FlushTiles)
    spark.udtf.register("charsets", Charsets)
