"""Text formats of neighbouring tools: polyDFE spectra, EST-SFS sites, spectra as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.spectra import Spectra, Spectrum


def read_polydfe(spark: SparkSession, path: str) -> Spectra:
    """Neutral and selected spectra, the rows of each class summed.

    First line: number of neutral and of selected rows, sample size. A row: n - 1 counts, sites, and
    optionally divergence counts and their sites.
    """
    lines = spark.read.text(path).withColumn("n", F.monotonically_increasing_id()).where((F.trim("value") != "") & ~F.col("value").startswith("#"))
    rows = [[float(x) for x in r[0].split()] for r in lines.orderBy("n").select("value").collect()]
    neutral, selected, n = (int(x) for x in rows[0])
    out = {}
    for name, part in (("neutral", rows[1 : 1 + neutral]), ("selected", rows[1 + neutral : 1 + neutral + selected])):
        total = [sum(x) for x in zip(*part, strict=True)]
        if total:
            out[name] = Spectrum.from_polydfe(total[: n - 1], total[n - 1], total[n] if len(total) > n else 0)
    return Spectra(out)


def read_est_sfs(spark: SparkSession, path: str) -> DataFrame:
    """(site_id, major_base, minor_base, outgroup_bases, n_major, multiplicity) of sites with at most two ingroup bases.

    Columns are base counts ``A,C,G,T``: the ingroup's, then one per outgroup.
    """
    lines = spark.read.text(path).where(F.trim("value") != "").withColumn("site_id", F.monotonically_increasing_id())
    columns = F.transform(F.split(F.trim("value"), r"\s+"), lambda c: F.split(c, ",").cast("array<int>"))
    df = lines.select("site_id", columns[0].alias("c"), F.slice(columns, 2, 100).alias("o"))
    ranked = F.sort_array(F.transform("c", lambda x, i: F.struct(x.alias("n"), (-i).alias("i"))), asc=False)
    df = df.withColumn("r", ranked).where((F.col("r")[2]["n"] == 0) & (F.col("r")[0]["n"] > 0))
    first = F.transform("o", lambda c: F.coalesce(F.array_position(F.transform(c, lambda x: x > 0), True), F.lit(0)).cast("int") - 1)
    return df.select("site_id", (-F.col("r")[0]["i"]).alias("major_base"), F.when(F.col("r")[1]["n"] > 0, -F.col("r")[1]["i"]).otherwise(-1).alias("minor_base"), first.alias("outgroup_bases"), F.col("r")[0]["n"].alias("n_major"), F.lit(1.0).alias("multiplicity"))


def write_est_sfs(configs: DataFrame, n_ingroups: int, path: str) -> None:
    """One line per site of its likeliest pattern."""
    best = configs.groupBy("site_id").agg(F.max_by(F.struct("major_base", "minor_base", "outgroup_bases", "n_major"), "multiplicity").alias("x"))

    def counts(base, n, other, m):
        return F.concat_ws(",", *(F.when(base == i, n).when(other == i, m).otherwise(0).cast("string") for i in range(4)))

    inside = counts(F.col("x.major_base"), F.col("x.n_major"), F.col("x.minor_base"), n_ingroups - F.col("x.n_major"))
    outs = F.transform("x.outgroup_bases", lambda b: F.concat_ws(",", *(F.when(b == i, 1).otherwise(0).cast("string") for i in range(4))))
    best.orderBy("site_id").select(F.concat_ws(" ", inside, F.array_join(outs, " ")).alias("value")).write.text(path)


def spectra_frame(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a column per type as a long frame."""
    wide = spark.read.csv(path, header=True, inferSchema=False)
    cells = F.array(*(F.struct(F.lit(t).alias("type"), F.col(f"`{t}`").cast("double").alias("mass")) for t in wide.columns))
    rows = wide.select(F.monotonically_increasing_id().alias("row"), F.explode(cells).alias("x"))
    from pyspark.sql import Window

    return rows.select("x.type", (F.row_number().over(Window.partitionBy("x.type").orderBy("row")) - 1).alias("bin"), "x.mass")
