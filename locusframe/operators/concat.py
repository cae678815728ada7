"""Concatenation of alignments and what goes with it: charsets, splitting, partitions, sampling."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Pieces of a concatenation's row that leave a task at once.
_PIECES = 4096


def charsets(aln: DataFrame) -> DataFrame:
    """(name, start, stop, ord): each locus's half-open range in the concatenation, loci in name order.

    One row a locus goes through the single ordered window, never a sequence.
    """
    lengths = aln.groupBy("locus").agg(F.max(F.length("seq")).cast("long").alias("n"))
    order = Window.orderBy("locus")
    running = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return lengths.select(F.col("locus").alias("name"), (running - F.col("n")).alias("start"), running.alias("stop"), (F.row_number().over(order) - 1).cast("int").alias("ord"))


def concat_matrix(aln: DataFrame, missing: str = "?") -> DataFrame:
    """(taxon, ord, seq): one row a taxon over all loci in name order, absent loci filled with the missing character.

    Taxa are in the order in which loci, by name, first have them. Of a taxon's repeated rows in a locus the
    first counts. Gaps between a taxon's pieces are filled from the running offsets, so absent loci need no rows.
    The taxa are numbered by names and places alone; sequences only meet their taxon's.
    """
    sets = charsets(aln)
    whole = sets.agg(F.max("stop").alias("whole"))
    once = aln.groupBy("locus", "taxon").agg(F.min_by("seq", "row_ord").alias("seq"), F.min("row_ord").alias("row_ord"))
    placed = once.join(sets.withColumnRenamed("name", "locus"), "locus")
    pieces = placed.groupBy("taxon").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "seq"))).alias("pieces"))
    firsts = aln.select("locus", "taxon", "row_ord").join(sets.select(F.col("name").alias("locus"), F.col("ord").alias("at")), "locus").groupBy("taxon").agg(F.min(F.struct("at", "row_ord")).alias("first"))
    order = firsts.select("taxon", (F.row_number().over(Window.orderBy("first", "taxon")) - 1).cast("int").alias("ord"))
    lack = lambda to, k: F.repeat(F.lit(missing), (to - F.coalesce(F.get("pieces", k)["stop"], F.lit(0))).cast("int"))
    filled = F.array_join(F.transform("pieces", lambda x, k: F.concat(lack(x["start"], k - 1), x["seq"])), "")
    done = pieces.join(F.broadcast(whole), F.lit(True))  # one row
    return done.select("taxon", F.concat(filled, lack(F.col("whole"), F.size("pieces") - 1)).alias("seq")).join(order, "taxon").select("taxon", "ord", "seq")


def split_concat(matrix: DataFrame, sets: DataFrame) -> DataFrame:
    """(locus, taxon, seq): each charset's columns of each row; rows with nothing but gaps or missing data go.

    Charsets travel as one array beside each row, and a row is cut by offsets, so the work is that of its length;
    pieces leave in batches of ``_PIECES`` whatever the number of loci.
    """
    listed = sets.agg(F.array_sort(F.collect_list(F.struct("ord", "name", "start", "stop"))).alias("sets"))
    rows = matrix.select("taxon", "seq").join(F.broadcast(listed), F.lit(True))  # one row

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds: list[tuple[str, int, int]] | None = None
        for batch in batches:
            for k in range(batch.num_rows):
                if bounds is None:  # the same array beside all rows
                    bounds = [(x["name"], x["start"], x["stop"]) for x in batch.column("sets")[k].as_py() or ()]
                taxon, seq = batch.column("taxon")[k].as_py(), batch.column("seq")[k].as_py() or ""
                for at in range(0, len(bounds), _PIECES):
                    kept = [(name, piece) for name, a, b in bounds[at : at + _PIECES] if (piece := seq[a:b]).strip("-?")]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in ([n for n, _ in kept], [taxon] * len(kept), [s for _, s in kept])], names=["locus", "taxon", "seq"])

    return rows.mapInArrow(cut, "locus string, taxon string, seq string")


def partition_slices(matrix: DataFrame, partitions: Sequence[tuple[str, Sequence[tuple[int, int]]]]) -> DataFrame:
    """(partition, taxon, seq): the concatenated ranges (from 1, both ends inside) of each partition."""
    parts = [F.struct(F.lit(name).alias("partition"), F.concat(*[F.substring("seq", a, b - a + 1) for a, b in ranges]).alias("seq")) for name, ranges in partitions]
    return matrix.select("taxon", F.explode(F.array(*parts)).alias("p")).select("p.partition", "taxon", "p.seq")


def sample_loci(aln: DataFrame, size: int, replicates: int, seed: int) -> DataFrame:
    """(replicate, locus, draw): ``size`` loci without replacement for each replicate, by hash order of a seed."""
    loci = aln.select("locus").distinct().select("locus", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    # loci of a replicate compete by a hash; a replicate's window holds names only
    order = Window.partitionBy("replicate").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("replicate").cast("string"), "locus").cast("binary")), "locus")
    return loci.withColumn("draw", F.row_number().over(order)).where(F.col("draw") <= size)


def sample_concat(aln: DataFrame, size: int, replicates: int, seed: int) -> DataFrame:
    """(replicate, taxon, seq): concatenations of the sampled loci in drawing order."""
    drawn = sample_loci(aln, size, replicates, seed)
    lengths = aln.groupBy("locus").agg(F.max(F.length("seq")).alias("n"))
    taxa = aln.select("taxon").distinct()
    grid = drawn.join(lengths, "locus").join(F.broadcast(taxa.agg(F.collect_set("taxon").alias("taxa"))), F.lit(True)).select("replicate", "draw", "locus", "n", F.explode("taxa").alias("taxon"))
    rows = grid.join(aln.select("locus", "taxon", "seq"), ["locus", "taxon"], "left").withColumn("seq", F.coalesce("seq", F.repeat(F.lit("?"), F.col("n"))))
    return rows.groupBy("replicate", "taxon").agg(F.array_sort(F.collect_list(F.struct("draw", "seq"))).alias("s")).select("replicate", "taxon", F.array_join(F.transform("s", lambda x: x["seq"]), "").alias("seq"))


def phylip_text(matrix: DataFrame) -> DataFrame:
    """Lines of a relaxed PHYLIP file: (ord, line), the dimensions first."""
    head = matrix.agg(F.count(F.lit(1)).alias("n"), F.max(F.length("seq")).alias("m")).select(F.lit(-1).alias("ord"), F.concat_ws(" ", "n", "m").alias("line"))
    return head.unionByName(matrix.select("ord", F.concat_ws(" ", "taxon", "seq").alias("line")))


def charset_text(sets: DataFrame) -> DataFrame:
    """Lines of a sets block: (ord, line); ranges count from 1 and include both ends."""
    line = F.concat(F.lit("charset '"), "name", F.lit("' = "), (F.col("start") + 1).cast("string"), F.lit("-"), F.col("stop").cast("string"), F.lit(";"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: F.concat(x["name"], F.lit(":"), x["name"])), ", ")
    head = sets.agg(F.lit(-1).alias("ord"), F.lit("begin sets;").alias("line"))
    tail = sets.agg((F.max("ord") + 1).alias("ord"), F.concat(F.lit("charpartition combined = "), joined, F.lit(";\nend;")).alias("line"))
    return head.unionByName(sets.select("ord", line.alias("line"))).unionByName(tail)


def paml_text(slices: DataFrame) -> DataFrame:
    """(partition, ord, line): blocks of padded names and sequences."""
    width = F.max(F.length("taxon")).over(Window.partitionBy("partition")) + 2
    rows = slices.withColumn("ord", F.row_number().over(Window.partitionBy("partition").orderBy("taxon"))).select("partition", "ord", F.concat(F.rpad(F.col("taxon"), width, F.lit(" ")), F.col("seq")).alias("line"))
    heads = slices.groupBy("partition").agg(F.lit(0).alias("ord"), F.concat_ws(" ", F.count(F.lit(1)), F.max(F.length("seq"))).alias("line"))
    return heads.unionByName(rows)
