"""VCF text as a DataFrame of sites, and back.

The reader splits lines with built-in functions, so a directory of plain files is read in parallel
(a gzip file is one task, as gzip cannot be split). site_id keeps the order within and between
files: file part, then line.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.genotypes import snp_flag

FIXED = ["CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT"]


@dataclass
class VariantSource:
    """Sites with what their header declares."""

    sites: DataFrame
    samples: list[str]
    contig_lengths: dict[str, int] = field(default_factory=dict)
    header: list[str] = field(default_factory=list)

    @property
    def contigs(self) -> list[str]:
        return list(self.contig_lengths)

    def sample_indices(self, include: list[str] | None = None, exclude: list[str] | None = None) -> list[int]:
        unknown = [s for s in [*(include or []), *(exclude or [])] if s not in self.samples]
        if unknown:
            raise ValueError(f"samples not in the source: {unknown}")
        return [i for i, s in enumerate(self.samples) if (include is None or s in include) and s not in (exclude or [])]

    def count(self) -> int:
        return self.sites.count()


def read_vcf(spark: SparkSession, path: str) -> VariantSource:
    lines = spark.read.text(path)
    header = [r[0] for r in lines.where(F.col("value").startswith("#")).collect()]
    names = next((h.split("\t") for h in header if h.startswith("#CHROM")), [])
    samples = names[len(FIXED) :]
    lengths = {}
    for h in header:
        if h.startswith("##contig=<"):
            parts = dict(p.split("=", 1) for p in h[len("##contig=<") : h.rindex(">")].split(",") if "=" in p)
            if "ID" in parts:
                lengths[parts["ID"]] = int(parts.get("length", 0) or 0)
    rows = lines.withColumn("site_id", F.monotonically_increasing_id()).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    f = F.split("value", "\t")
    alt = F.filter(F.split(F.get(f, F.lit(4)), ","), lambda a: (a != ".") & (a != ""))
    entries = F.transform(F.filter(F.split(F.get(f, F.lit(7)), ";"), lambda x: (x != "") & (x != ".")), lambda x: F.struct(F.substring_index(x, "=", 1).alias("key"), F.when(x.contains("="), F.regexp_replace(x, "^[^=]*=", "")).otherwise(F.lit("true")).alias("value")))
    info = F.map_from_entries(F.transform(F.array_distinct(F.transform(entries, lambda e: e["key"])), lambda k: F.struct(k, F.get(F.filter(entries, lambda e: e["key"] == k), F.lit(0))["value"])))
    at = F.array_position(F.split(F.coalesce(F.get(f, F.lit(8)), F.lit("")), ":"), "GT")
    calls = F.transform(F.slice(f, len(FIXED) + 1, max(len(samples), 1)), lambda s: F.try_element_at(F.split(s, ":"), at.cast("int")))

    def codes(call: Column) -> Column:
        return F.transform(F.split(F.coalesce(call, F.lit(".")), "[/|]"), lambda c: F.when(c.rlike("^[0-9]+$"), c.try_cast("int")).otherwise(-1))

    has = (at > 0) if samples else F.lit(False)
    base = rows.select(
        "site_id", F.get(f, F.lit(0)).alias("chrom"), F.get(f, F.lit(1)).try_cast("bigint").alias("pos"), F.get(f, F.lit(3)).alias("ref"), alt.alias("alt"),
        F.when(has, F.transform(calls, codes)).alias("gt"), F.when(has, F.transform(calls, lambda c: F.coalesce(c.contains("|"), F.lit(False)))).alias("phased"), info.alias("info"),
    )
    return VariantSource(with_classes(base), samples, lengths, header)


def with_classes(df: DataFrame) -> DataFrame:
    """Add the variant class columns and the column order of the site schema."""
    plain = F.forall("alt", lambda a: a.rlike("^[ACGTN*]+$"))
    longer = F.exists("alt", lambda a: F.length(a) != F.length("ref"))
    any_alt = F.size("alt") > 0
    symbolic = F.exists("alt", lambda a: a.contains("<") | a.contains("[") | a.contains("]"))
    df = df.withColumns({"is_snp": F.coalesce(snp_flag(), F.lit(False)), "is_sv": any_alt & symbolic})
    df = df.withColumns(
        {
            "is_mnp": any_alt & ~F.col("is_sv") & (F.length("ref") > 1) & ~longer,
            "is_indel": any_alt & ~F.col("is_sv") & plain & longer,
            "is_deletion": any_alt & ~F.col("is_sv") & plain & (F.size("alt") == 1) & (F.length(F.col("alt")[0]) < F.length("ref")),
            "is_dummy": F.lit(False),
        }
    )
    return df.select("site_id", "chrom", "pos", "ref", "alt", "gt", "phased", "is_snp", "is_mnp", "is_indel", "is_deletion", "is_sv", "is_dummy", "info")


def from_table(df: DataFrame, samples: list[str] | None = None, contig_lengths: dict[str, int] | None = None) -> VariantSource:
    """Any DataFrame with the site schema; missing class columns are derived."""
    if "is_snp" not in df.columns:
        df = with_classes(df)
    return VariantSource(df, samples or [], contig_lengths or {})


def write_vcf(source: VariantSource, path: str, info_headers: dict[str, str] | None = None) -> None:
    """One VCF text per partition, in site order; every part starts with the header."""
    header = [h for h in source.header if h.startswith("##")] or ["##fileformat=VCFv4.2", *(f"##contig=<ID={c},length={n}>" if n else f"##contig=<ID={c}>" for c, n in source.contig_lengths.items())]
    header += [f'##INFO=<ID={k},Number=1,Type=String,Description="{v}">' for k, v in (info_headers or {}).items()]
    header.append("#" + "\t".join(FIXED[: 9 if source.samples else 8] + source.samples))
    codes = F.transform("gt", lambda g: F.transform(F.filter(g, lambda c: c > -2), lambda c: F.when(c >= 0, c.cast("string")).otherwise(".")))
    gt = F.transform(codes, lambda g, i: F.when(F.coalesce(F.try_element_at("phased", i + 1), F.lit(False)), F.array_join(g, "|")).otherwise(F.array_join(g, "/")))
    dot = F.lit(".")
    info = F.when(F.size("info") > 0, F.array_join(F.transform(F.array_sort(F.map_entries("info")), lambda e: F.when(e["value"] == "true", e["key"]).otherwise(F.concat(e["key"], F.lit("="), e["value"]))), ";")).otherwise(dot)
    fields = [F.col("chrom"), F.col("pos").cast("string"), dot, F.col("ref"), F.when(F.size("alt") > 0, F.array_join("alt", ",")).otherwise(dot), dot, dot, F.coalesce(info, dot)]
    if source.samples:
        fields += [F.lit("GT"), F.array_join(gt, "\t")]
    ordered = source.sites.repartitionByRange("site_id").sortWithinPartitions("site_id") if source.sites.rdd.getNumPartitions() > 1 else source.sites.sort("site_id")

    def lines(batches):
        import pyarrow as pa

        first = True
        for batch in batches:
            rows = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_pydict({"value": (header if first else []) + rows})
            first = False

    ordered.select(F.concat_ws("\t", *fields).alias("value")).mapInArrow(lines, "value string").write.mode("error").text(path)
