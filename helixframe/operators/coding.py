"""Degeneracy and synonymy of coding sites.

A site takes the coding sequence with the smallest start among those that contain it (ties by end,
then file order). Its codon is read on the sequence's strand; bases past either edge of the coding
sequence come from the neighbouring one of the same transcript.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codons
from ..sources.reference import CHUNK, alias_column, sequence_chunks
from .ancestral import set_info
from .filters import Context

WIDTH = 1 << 14


def with_neighbours(cds: DataFrame) -> DataFrame:
    """Add the nearest previous and next coding sequence of the same parent that do not overlap.

    Inside a parent the sequences are few and ordered; the next one is the first that starts after
    this one's end, the previous one the last that ends before its start.
    """
    after = Window.partitionBy("seqid", "parent").orderBy("start").rangeBetween(1, Window.unboundedFollowing)
    # among the later starts, those past this end: kept as an ordered list, which is a transcript's length
    later = F.sort_array(F.collect_list(F.struct("start", "end")).over(after))
    before = Window.partitionBy("seqid", "parent").orderBy("start").rangeBetween(Window.unboundedPreceding, -1)
    earlier = F.sort_array(F.collect_list(F.struct("end", "start")).over(before), asc=False)
    df = cds.withColumns({"_later": later, "_earlier": earlier})
    nxt = F.get(F.filter("_later", lambda x: x["start"] > F.col("end")), F.lit(0))
    prv = F.get(F.filter("_earlier", lambda x: x["end"] < F.col("start")), F.lit(0))
    return df.withColumns({"next_start": nxt["start"], "next_end": nxt["end"], "prev_start": prv["start"], "prev_end": prv["end"]}).drop("_later", "_earlier")


def locate(sites: DataFrame, cds: DataFrame, aliases=None) -> DataFrame:
    """Sites with the struct ``cds`` of the coding sequence that holds them (null outside)."""
    spans = with_neighbours(cds)
    if "file_order" not in spans.columns:
        spans = spans.withColumn("file_order", F.lit(0).cast("bigint"))
    body = F.struct("start", "end", "file_order", "strand", "phase", "parent", "next_start", "next_end", "prev_start", "prev_end")
    bins = spans.select(alias_column(F.col("seqid"), aliases).alias("_contig"), body.alias("_cds"), F.explode(F.sequence(F.floor(F.col("start") / WIDTH), F.floor(F.col("end") / WIDTH))).alias("_bin"))
    keyed = sites.withColumns({"_contig": alias_column(F.col("chrom"), aliases), "_bin": F.floor(F.col("pos") / WIDTH)})
    hits = keyed.select("site_id", "pos", "_contig", "_bin").join(bins, ["_contig", "_bin"]).where(F.col("pos").between(F.col("_cds.start"), F.col("_cds.end")))
    # a struct compares field by field: smallest start, then end, then file order
    best = hits.groupBy("site_id").agg(F.min("_cds").alias("cds"))
    return sites.join(best, "site_id", "left")


def codon_places(strand: Column, pos: Column) -> tuple[Column, Column]:
    """(place in the codon, genomic positions of its three bases in reading order; null off the edge).

    The place counts from the start of the reading frame: forwards on ``+``, backwards on ``-``.
    """
    c = F.col("cds")
    forward = strand == "+"
    place = F.when(forward, F.pmod(pos - c["start"] - c["phase"], F.lit(3))).otherwise(F.pmod(c["end"] - c["phase"] - pos, F.lit(3)))

    def at(k: int) -> Column:
        p = F.when(forward, pos - place + k).otherwise(pos + place - k)
        left = c["prev_end"] - (c["start"] - 1 - p)
        right = c["next_start"] + (p - c["end"] - 1)
        return F.when(p < c["start"], F.when(left >= c["prev_start"], left)).when(p > c["end"], F.when(right <= c["next_end"], right)).otherwise(p)

    return place.cast("int"), F.array(at(0), at(1), at(2))


def with_codons(sites: DataFrame, ctx: Context) -> DataFrame:
    """Sites with ``cds``, ``_place`` and ``_codon`` (on the coding strand, null where a base is unknown)."""
    located = locate(sites, ctx.need("cds", "coding annotation"), ctx.aliases)
    place, places = codon_places(F.col("cds.strand"), F.col("pos"))
    df = located.withColumns({"_place": place, "_places": places})
    chunks = sequence_chunks(ctx.need("fasta", "coding annotation"), overlap=0).select(alias_column(F.col("contig"), ctx.aliases).alias("_contig"), F.col("chunk").alias("_chunk"), "offset", "piece")
    # a codon may span chunks: each of its bases is looked up where it lies
    wanted = df.where("cds is not null").select("site_id", alias_column(F.col("chrom"), ctx.aliases).alias("_contig"), F.posexplode("_places").alias("k", "p")).where("p is not null and p > 0")
    wanted = wanted.withColumn("_chunk", F.floor((F.col("p") - 1) / CHUNK).cast("int"))
    letters = wanted.join(chunks, ["_contig", "_chunk"]).select("site_id", "k", F.upper(F.substring("piece", (F.col("p") - F.col("offset")).cast("int"), F.lit(1))).alias("b"))
    codon = letters.groupBy("site_id").agg(F.sort_array(F.collect_list(F.struct("k", "b"))).alias("c"))
    text = F.when(F.size("c") == 3, F.concat(F.col("c")[0]["b"], F.col("c")[1]["b"], F.col("c")[2]["b"]))
    df = df.join(codon.select("site_id", text.alias("_raw")), "site_id", "left")
    codon_text = F.when(F.col("cds.strand") == "-", F.translate("_raw", "ACGT", "TGCA")).otherwise(F.col("_raw"))
    return df.withColumn("_codon", F.when(codon_text.rlike("^[ACGT]{3}$"), codon_text)).drop("_raw", "_places")


def _on_strand(base: Column) -> Column:
    return F.when(F.col("cds.strand") == "-", F.translate(base, "ACGT", "TGCA")).otherwise(base)


def annotate_degeneracy(sites: DataFrame, ctx: Context) -> DataFrame:
    """Tags ``Degeneracy`` (0, 2, 4 or a dot) and ``Degeneracy_Info`` (place,strand,codon).

    Sites whose reference is longer than a base, outside coding sequences, at an incomplete codon, or
    whose reference base differs from the sequence's get a dot.
    """
    df = with_codons(sites, ctx)
    spark = sites.sparkSession
    table = F.broadcast(spark.createDataFrame(codons.degeneracy_rows(), "_codon string, _place int, _deg int"))
    df = df.join(table, ["_codon", "_place"], "left")
    fits = (F.length("ref") == 1) & (F.substring("_codon", F.col("_place") + 1, F.lit(1)) == _on_strand(F.upper("ref")))
    value = F.when(fits, F.col("_deg").cast("string"))
    df = set_info(df, "Degeneracy_Info", F.coalesce(F.when(value.isNotNull(), F.concat_ws(",", F.col("_place").cast("string"), F.col("cds.strand"), F.col("_codon"))), F.lit(".")))
    return set_info(df, "Degeneracy", F.coalesce(value, F.lit("."))).select(*sites.columns)


def codon_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(codons.CODE.items()), "codon string, amino string")


def annotate_synonymy(sites: DataFrame, ctx: Context) -> DataFrame:
    """Tags ``Synonymy`` (1, 0 or a dot) and ``Synonymy_Info`` (codon/alternative[,start_gained][,stop_gained]) of SNPs.

    Both stay a dot where the codons that a VEP ``CSQ`` tag names are others, or where a SnpEff ``ANN`` tag
    states another synonymy.
    """
    df = with_codons(sites, ctx)
    alt = _on_strand(F.upper(F.get("alt", F.lit(0))))
    fits = F.col("is_snp") & (F.length("ref") == 1) & (F.substring("_codon", F.col("_place") + 1, F.lit(1)) == _on_strand(F.upper("ref")))
    other = F.when(fits, F.concat(F.expr("substring(_codon, 1, _place)"), alt, F.expr("substring(_codon, _place + 2)")))
    df = df.withColumn("_other", other)
    code = codon_table(sites.sparkSession)
    df = df.join(F.broadcast(code.select(F.col("codon").alias("_codon"), F.col("amino").alias("_a"))), "_codon", "left").join(F.broadcast(code.select(F.col("codon").alias("_other"), F.col("amino").alias("_b"))), "_other", "left")
    value = F.coalesce((F.col("_a") == F.col("_b")).cast("int").cast("string"), F.lit("."))
    vep = F.regexp_extract_all(F.regexp_extract(F.coalesce(F.try_element_at("info", F.lit("CSQ")), F.lit("")), "([actgACTG]{3}/[actgACTG]{3})", 1), F.lit("[a-zA-Z]{3}"), 0)
    named = F.transform(vep, F.upper)
    ours = F.array("_codon", "_other")
    by_codons = (F.size(named) > 0) & ((F.size(F.array_except(named, ours)) > 0) | (F.size(F.array_except(ours, named)) > 0))
    snpeff = F.try_element_at("info", F.lit("ANN"))
    says = F.when(snpeff.contains("synonymous_variant"), "1").when(snpeff.contains("missense_variant"), "0")
    kept = F.col("_other").isNotNull() & ~by_codons & F.coalesce(says == value, F.lit(True))
    gained = F.concat(F.when(F.col("_other") == "ATG", ",start_gained").otherwise(""), F.when(F.col("_b") == "*", ",stop_gained").otherwise(""))
    df = df.withColumns({"_value": F.when(kept, value).otherwise("."), "_text": F.when(kept, F.concat("_codon", F.lit("/"), "_other", gained)).otherwise(".")})
    return set_info(set_info(df, "Synonymy_Info", F.col("_text")), "Synonymy", F.col("_value")).select(*sites.columns)
