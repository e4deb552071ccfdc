"""Reference sequences (FASTA) and gene annotations (GFF, GTF)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

CHUNK = 1 << 16


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(contig, seq); the first of several records of one name counts."""
    records = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "").withColumn("n", F.monotonically_increasing_id())
    head = F.substring_index("value", "\n", 1)
    parsed = records.select("n", F.split(F.trim(head), r"\s+")[0].alias("contig"), F.regexp_replace(F.expr("substring(value, instr(value, '\n') + 1)"), r"\s+", "").alias("seq"))
    return parsed.groupBy("contig").agg(F.min_by("seq", "n").alias("seq"))


def sequence_chunks(fasta: DataFrame, size: int = CHUNK, overlap: int = 64) -> DataFrame:
    """(contig, chunk, offset, piece, length): pieces of ``size`` bases with ``overlap`` more on either side.

    Sites join on (contig, pos div size), so that no task needs a whole chromosome.
    """
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.floor((F.length("seq") - 1) / size), F.lit(0)).cast("int")))
    cut = fasta.select("contig", "seq", F.length("seq").alias("length"), at.alias("chunk"))
    offset = F.greatest(F.col("chunk") * size - overlap, F.lit(0))
    return cut.select("contig", "chunk", "length", offset.cast("bigint").alias("offset"), F.expr(f"substring(seq, greatest(chunk * {size} - {overlap}, 0) + 1, {size} + 2 * {overlap})").alias("piece"))


def base_at(pos, piece="piece", offset="offset"):
    """The base at a 1-based position, upper case; empty outside the piece."""
    at = (pos - F.col(offset)).cast("int")
    return F.when(at >= 1, F.upper(F.substring(F.col(piece), at, F.lit(1)))).otherwise(F.lit(""))


def read_cds(spark: SparkSession, path: str) -> DataFrame:
    """(seqid, start, end, strand, phase, parent) of the CDS rows, each (seqid, start, end) once, the first in the file.

    Lines after a ``##FASTA`` pragma, comments, and rows without all used columns are left out.
    """
    lines = spark.read.text(path).withColumn("n", F.monotonically_increasing_id())
    end = lines.where(F.col("value").startswith("##FASTA")).agg(F.min("n")).first()[0]
    if end is not None:
        lines = lines.where(F.col("n") < end)
    f = F.split(F.substring_index("value", "#", 1), "\t")
    rows = lines.where(~F.col("value").startswith("#")).select(
        "n", F.get(f, F.lit(0)).alias("seqid"), F.get(f, F.lit(2)).alias("type"), F.get(f, F.lit(3)).try_cast("bigint").alias("start"), F.get(f, F.lit(4)).try_cast("bigint").alias("end"),
        F.get(f, F.lit(6)).alias("strand"), F.get(f, F.lit(7)).alias("phase"), F.regexp_extract(F.get(f, F.lit(8)), r'(?:^|;)\s*(?:Parent|transcript_id)[=\s]"?([^;"]+)', 1).alias("parent"),
    ).where((F.col("type") == "CDS") & F.col("start").isNotNull() & F.col("end").isNotNull() & F.col("strand").isNotNull() & F.col("phase").isNotNull())
    first = Window.partitionBy("seqid", "start", "end").orderBy("n")
    return rows.withColumn("k", F.row_number().over(first)).where("k = 1").select("seqid", "start", "end", "strand", F.coalesce(F.col("phase").try_cast("int"), F.lit(0)).alias("phase"), "parent", F.col("n").alias("file_order"))


def remove_overlaps(cds: DataFrame) -> DataFrame:
    """Drop a coding sequence whose successor on the contig starts at or before its end."""
    following = F.lead("start").over(Window.partitionBy("seqid").orderBy("start", "end"))
    return cds.withColumn("next_start", following).where(F.col("next_start").isNull() | (F.col("next_start") > F.col("end"))).drop("next_start")


def coding_lengths(cds: DataFrame, overlaps: bool = True, contigs: list[str] | None = None) -> DataFrame:
    """(seqid, length): coding positions per contig; of several sequences of one start the first counts."""
    rows = cds if contigs is None else cds.where(F.col("seqid").isin(contigs))
    rows = rows.dropDuplicates(["seqid", "start"])
    if not overlaps:
        rows = remove_overlaps(rows)
    return rows.groupBy("seqid").agg(F.sum(F.col("end") - F.col("start") + 1).alias("length"))


def alias_column(column, groups: list[list[str]] | None):
    """The first name of a contig's alias group; a name in no group stays."""
    pairs = [F.lit(x) for g in groups or [] for name in g for x in (name, g[0])]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), column), column) if pairs else column
