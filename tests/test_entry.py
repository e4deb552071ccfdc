import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"


def test_every_sql_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["sfs_1d_stratified", "sfs_joint2", "two_site", "filter_chain", "chunked", "sfs_genotypes", "cds_overlap_removal", "sfs_random_bin", "sfs_prob_sites", "degeneracy_annotated", "synonymy_annotated", "vcf_round_trip", "gff_read", "spectra_csv", "two_site_cov", "sfs_joint3"])
def test_queries_match_sql(spark, name):
    import duckdb

    import __spark_entry__ as e

    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = e.queries()[name](spark, SF).toPandas()
    want = con.execute(e.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(tuple, got[columns].itertuples(index=False)), key=str) == sorted(map(tuple, want[columns].itertuples(index=False)), key=str)


def site_tables(path, n, copies, derived):
    """n parts of two types with ``copies`` line items each, ``derived`` of them derived, and a type whose parts have 3."""
    import duckdb

    con = duckdb.connect()
    con.execute(f"copy (select i as p_partkey, 'b' || i % 5 as p_brand, case when i >= {n} then 'few' when i % 3 = 0 then 'x' else 'y' end as p_type, cast(i % 50 as int) as p_size from range({n} + 30) t(i)) to '{path}/part.parquet' (format parquet)")
    con.execute(f"copy (select i as l_partkey, case when j % 2 = 0 then 'A' else 'R' end as l_returnflag, case when j < {derived} then 'F' else 'O' end as l_linestatus from range({n} + 30) t(i), range({copies}) u(j) where i < {n} or j < 3) to '{path}/lineitem.parquet' (format parquet)")
    for t in ("part", "lineitem"):
        con.execute(f"create view {t} as select * from '{path}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["target_sites_1d", "target_sites_joint"])
@pytest.mark.parametrize(("n", "copies", "derived"), [(60_000, 10, "(i * 7) % 11"), (600, 12, "(i * 7) % 13"), (60, 10, "9"), (30, 3, "1")])
def test_target_sites_match_sql(spark, tmp_path, name, n, copies, derived):
    """More sites than the target, fewer, none at or near the origin, and none with enough haplotypes."""
    import __spark_entry__ as e

    con = site_tables(tmp_path, n, copies, derived)
    got = e.queries()[name](spark, str(tmp_path)).toPandas()
    want = con.execute(e.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns) and (len(want) > 0) == (copies > 3)
    assert sorted(map(tuple, got[columns].itertuples(index=False)), key=str) == sorted(map(tuple, want[columns].itertuples(index=False)), key=str)


def test_the_rest_stands_without_the_training_operators(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'sfs_1d' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, timeout=120)


def test_command_line(spark, tmp_path):
    from helixframe.plans import cli

    vcf = tmp_path / "x.vcf"
    vcf.write_text("##contig=<ID=1,length=100>\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb\n1\t10\t.\tA\tT\t.\t.\tAA=A\tGT\t0/1\t0/0\n1\t20\t.\tC\tG\t.\t.\tAA=C\tGT\t1/1\t0/1\n")
    parse = ["parse", "--vcf", str(vcf), "--n", "4", "--output"]
    assert cli.run(cli.build_parser().parse_args([*parse, str(tmp_path / "o.csv")]), spark) == 0
    assert (tmp_path / "o.csv").read_text().split() == ["all", "0.0", "1.0", "0.0", "1.0", "0.0"]
    assert cli.run(cli.build_parser().parse_args([*parse, str(tmp_path / "n.csv"), "--contigs", "9"]), spark) == 1 and not (tmp_path / "n.csv").exists()
    assert cli.run(cli.build_parser().parse_args(["filter", "--vcf", str(vcf), "--output", str(tmp_path / "f.vcf"), "--filter", "biased-gc"]), spark) == 0
    for bad in ([*parse, str(vcf)], [*parse, str(tmp_path / "z"), "--stratify", "nothing"]):
        with pytest.raises(SystemExit):
            cli.run(cli.build_parser().parse_args(bad), spark)
    assert cli.populations("A=s1,s2;B=s3") == {"A": ["s1", "s2"], "B": ["s3"]}


def test_stream_equals_batch(spark, tmp_path):
    from helixframe.operators.project import spectrum_1d
    from helixframe.plans import tables
    from helixframe.streaming.incremental import spectrum_sink

    keys = tables.keys(spark, SF).where("m_0 >= 10").select("type", "m_0", "der_0", "w")
    for k in range(3):
        keys.where(f"pmod(der_0, 3) = {k}").write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(keys.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in/*"))
    q = spectrum_sink(stream, 10, str(tmp_path / "out"), str(tmp_path / "state"))
    q.processAllAvailable()
    last = q.lastProgress["batchId"]
    q.stop()
    batches = sorted((tmp_path / "out").iterdir(), key=lambda p: int(p.name.split("=")[1]))
    got = {(r["type"], r["bin"]): r["mass"] for r in spark.read.parquet(str(batches[-1])).collect()}
    want = {(r["type"], r["bin"]): r["mass"] for r in spectrum_1d(keys, 10).collect()}
    assert last >= 0 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
