import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import naive
from helixframe.functions.genotypes import SITES, genotype_strings
from helixframe.operators import ancestral, coding, filters, project, strata
from helixframe.plans.builder import SpectrumQuery, annotate_variants, filter_variants, sampled_opportunities
from helixframe.sources import reference
from helixframe.sources.vcf import VariantSource, from_table, read_vcf, write_vcf

NAMES = ["a", "b", "c", "d", "out"]


def random_sites(seed, n=150):
    rng = random.Random(seed)
    rows, pos = [], 0
    for i in range(n):
        pos += rng.choice([0, 1, 3, 40])
        ref = rng.choice("ACGT")
        alt = rng.sample([b for b in "ACGT" if b != ref], rng.choice([1, 1, 1, 2]))
        gt = [[rng.choice([0, 0, 1, 1, len(alt), -1]) for _ in range(2)] for _ in range(4)] + [[rng.choice([0, 1])]]
        info = {"AA": rng.choice([ref, ref, alt[0], "N", rng.choice("ACGT")]), "AA_prob": str(rng.choice([1.0, 0.8, 0.25]))}
        rows.append({"site_id": i, "chrom": "1" if i < 100 else "2", "pos": pos, "ref": ref, "alt": alt, "gt": gt, "phased": None, "is_snp": True, "is_mnp": False, "is_indel": False, "is_deletion": False, "is_sv": False, "is_dummy": False, "info": info})
    return rows


def source(spark, rows, lengths=None):
    return VariantSource(spark.createDataFrame(rows, SITES), NAMES, lengths or {})


@pytest.mark.parametrize("seed", [0, 1])
def test_spectrum_matches_rows(spark, seed):
    rows = random_sites(seed)
    got = SpectrumQuery(source(spark, rows), 6, filters=[]).run()
    assert np.allclose(got.all.data, naive.spectrum(rows, 6))
    got = SpectrumQuery(source(spark, rows), 4, filters=[], skip_non_polarized=False, strata=[strata.Contig()]).run()
    assert got.types == ["1", "2"]
    assert np.allclose(got.all.data, naive.spectrum(rows, 4, False))


def test_probabilistic_polarization_splits_each_site(spark):
    rows = random_sites(2)
    got = SpectrumQuery(source(spark, rows), 4, filters=[], polarize_probabilistically=True).run().all.data
    want = np.zeros(5)
    for r in rows:
        k = naive.key(r, 4)
        if k:
            v = np.array([naive.pmf(*k, i, 4) for i in range(5)])
            p = float(r["info"]["AA_prob"])
            want += p * v + (1 - p) * v[::-1]
    assert np.allclose(got, want)


def test_random_mode_draws_each_site_once(spark):
    rows = random_sites(3)
    total = sum(naive.key(r, 4) is not None for r in rows)
    a = SpectrumQuery(source(spark, rows), 4, filters=[], subsample_mode="random").run().all
    b = SpectrumQuery(source(spark, rows), 4, filters=[], subsample_mode="random").run().all
    assert a == b and a.n_sites == total and all(x == int(x) for x in a)


def test_joint_marginals_and_strata_partition(spark):
    rows = random_sites(4)
    q = SpectrumQuery(source(spark, rows), [2, 3], {"x": ["a", "b"], "y": ["c", "d"]}, filters=[])
    joint = q.run().all
    split = SpectrumQuery(source(spark, rows), [2, 3], {"x": ["a", "b"], "y": ["c", "d"]}, filters=[], strata=[strata.TransitionTransversion()]).run()
    assert np.allclose(split.all.data, joint.data)
    assert np.isclose(joint.marginalize(["y"]).data.sum(), joint.data.sum())
    assert joint.shape == (3, 4) and np.isclose(joint.fold().data.sum(), joint.data.sum())


@pytest.mark.parametrize("d,offset", [(1, 0), (100, 0), (50, 25)])
def test_pairs_match_brute_force_and_window_form(spark, d, offset):
    rows = random_sites(5, 120)
    q = SpectrumQuery(source(spark, rows), 3, filters=[], skip_non_polarized=False, two_sfs=True, d=d, two_sfs_offset=offset)
    got = q.run()
    assert np.allclose(got.all.data, naive.pairs(rows, 3, d, offset), rtol=1e-9, atol=1e-9)
    window = project.two_site_window(q.keys(), 3, d, offset).toPandas()
    dense = np.zeros((4, 4))
    dense[window["i"], window["j"]] = window["mass"]
    assert np.allclose(dense, got.all.data)


def test_pairs_with_target_sites_and_random_draws(spark):
    rows = random_sites(5, 120)
    extents = {c: [r["pos"] for r in rows if r["chrom"] == c] for c in "12"}
    for lengths in ({}, {"1": 40_000, "2": 5_000, "9": 10**6}):
        plain = SpectrumQuery(source(spark, rows, lengths), 3, filters=[], skip_non_polarized=False, two_sfs=True, d=100)
        seen = plain.keys().toPandas().groupby("chrom")["pos"].agg(["min", "max"])
        span = {c: lengths.get(c, int(seen.loc[c, "max"] - seen.loc[c, "min"])) for c in extents}
        marginal = SpectrumQuery(plain.source, 3, filters=[], skip_non_polarized=False).run().all.data
        missing, region = 50_000 - marginal.sum(), sum(span.values())
        per_site = missing / region * 100 * sum((1 - 100 / (2 * x) if x >= 100 else x / 200) * x for x in span.values()) / region
        want = np.array(naive.pairs(rows, 3, 100, 0))
        want[0] += marginal * per_site
        want[:, 0] += marginal * per_site
        want[0, 0] += missing * per_site
        got = SpectrumQuery(plain.source, 3, filters=[], skip_non_polarized=False, two_sfs=True, d=100, n_target_sites=50_000).run()
        assert np.allclose(got.all.data, want)
    few = SpectrumQuery(plain.source, 3, filters=[], skip_non_polarized=False, two_sfs=True, d=100, n_target_sites=1).run()
    assert np.allclose(few.all.data, naive.pairs(rows, 3, 100, 0))
    with pytest.raises(NotImplementedError):
        SpectrumQuery(plain.source, 3, filters=[], strata=[strata.Contig()], two_sfs=True, n_target_sites=9).frame()

    # each site is one draw: whole counts of pairs, of the same sites as the random spectrum
    drawn = SpectrumQuery(plain.source, 3, filters=[], skip_non_polarized=False, two_sfs=True, d=100, subsample_mode="random", seed=4)
    keys = project.drawn(plain.keys(), 3, 4).toPandas()
    want = np.zeros((4, 4))
    for c, part in keys.groupby("chrom"):
        for p, i in zip(part["pos"], part["der_0"], strict=True):
            for q, j in zip(part["pos"], part["der_0"], strict=True):
                if 0 < q - p <= 100:
                    want[i, j] += 0.5
                    want[j, i] += 0.5
    assert np.allclose(drawn.run().all.data, want) and not np.allclose(want, naive.pairs(rows, 3, 100, 0))
    alone = SpectrumQuery(plain.source, 3, filters=[], skip_non_polarized=False, subsample_mode="random", seed=4).run().all.data
    assert np.allclose(np.bincount(keys["der_0"], minlength=4), alone)


def test_monomorphic_and_other_sites(spark):
    base = random_sites(6, 1)[0]
    mono = base | {"alt": [], "gt": [[0, 0]] * 4 + [[0]], "is_snp": False}
    rows = [mono | {"info": {}}, mono | {"site_id": 1, "info": {"AA": "A" if base["ref"] != "A" else "C"}}, mono | {"site_id": 2, "is_indel": True}]
    got = SpectrumQuery(source(spark, rows), 4, filters=[]).run().all
    assert got.to_list() == [1, 0, 0, 0, 1]


def test_arguments_are_checked(spark):
    s = source(spark, random_sites(0, 2))
    with pytest.raises(ValueError):
        SpectrumQuery(s, 1)
    with pytest.raises(NotImplementedError):
        SpectrumQuery(s, [2, 2], {"x": ["a"], "y": ["b"]}, two_sfs=True)
    with pytest.raises(ValueError):
        SpectrumQuery(s, 2, include_samples=["nobody"])
    with pytest.raises(ValueError):
        SpectrumQuery(s, 2, filters=[filters.CpGFilter()]).run()


def test_outgroup_filters(spark):
    row = random_sites(0, 1)[0] | {"ref": "A", "alt": ["T"]}
    layouts = [([[0, 0]] * 4, [0]), ([[0, 0]] * 4, [1]), ([[0, 0]] * 4, [-1]), ([[1, 1], [0, 0], [1, 0], [0, 1]], [1])]
    rows = [row | {"site_id": i, "gt": [*g, o]} for i, (g, o) in enumerate(layouts)]
    s = source(spark, rows)

    def ids(*f):
        return sorted(r[0] for r in filter_variants(s, f).sites.select("site_id").collect())

    assert ids(filters.DeviantOutgroupFilter(["out"])) == [0, 3]
    assert ids(filters.DeviantOutgroupFilter(["out"], strict=False)) == [0, 2, 3]
    assert ids(filters.ExistingOutgroupFilter(["out"])) == [0, 1, 3]
    assert ids(filters.SNPFilter()) == [1, 3] and ids(filters.SNPFilter(exclude=["out"])) == [3]
    assert filters.count_rejected(s.sites, [filters.SNPFilter(), filters.AllFilter()], filters.Context(NAMES)) == [2, 2]


def write(path, text):
    path.write_text(text)
    return str(path)


CONTIG = "ATGGTTTTTCGTTATTAA"


@pytest.fixture
def coding_tables(spark, tmp_path):
    fasta = write(tmp_path / "x.fa", f">1 first\n{CONTIG[:10]}\n{CONTIG[10:]}\n>2\nACGT\n>1\nTTTT\n")
    gff = write(tmp_path / "x.gff", "##gff-version 3\n1\tx\tCDS\t1\t18\t.\t+\t0\tID=c;Parent=t1\n1\tx\tCDS\t1\t18\t.\t+\t0\tParent=t2\n1\tx\texon\t1\t18\t.\t+\t.\tParent=t1\n##FASTA\n1\tx\tCDS\t1\t9\t.\t+\t0\tParent=t3\n")
    return reference.read_fasta(spark, fasta), reference.read_cds(spark, gff)


def snps(positions, sequence=CONTIG):
    other = {"A": "G", "G": "A", "C": "T", "T": "C"}
    base = random_sites(0, 1)[0]
    return [base | {"site_id": i, "chrom": "1", "pos": p, "ref": sequence[p - 1], "alt": [other[sequence[p - 1]]], "info": {}} for i, p in enumerate(positions)]


def test_reference_readers(coding_tables):
    fasta, cds = coding_tables
    assert dict(fasta.collect()) == {"1": CONTIG, "2": "ACGT"}
    assert [(r["start"], r["end"], r["parent"]) for r in cds.collect()] == [(1, 18, "t1")]


def test_degeneracy_and_synonymy(spark, coding_tables):
    fasta, cds = coding_tables
    rows = snps([4, 5, 6, 9, 12, 15])
    s = source(spark, rows)
    out = annotate_variants(s, [coding.annotate_degeneracy, coding.annotate_synonymy], fasta=fasta, cds=cds).sites.orderBy("site_id").collect()
    assert [r["info"]["Degeneracy"] for r in out] == ["0", "0", "4", "2", "4", "2"]
    assert [r["info"]["Synonymy"] for r in out] == ["0", "0", "1", "1", "1", "1"]
    assert out[2]["info"]["Synonymy_Info"] == "GTT/GTC"


def test_stated_codons_and_effects_are_checked(spark, coding_tables):
    fasta, cds = coding_tables
    s = source(spark, snps([6, 9, 12, 15]))
    for tag, texts, want in (
        ("CSQ", ["x|gtT/gtC|y", "GTT/GAA", "synonymous_variant", "missense_variant"], ["1", ".", "1", "1"]),  # only codons count
        ("ANN", ["missense_variant", "synonymous_variant", "intron_variant", ""], [".", "1", "1", "1"]),
    ):
        column = F.element_at(F.array(*(F.lit(t) for t in texts)), (F.col("site_id") + 1).cast("int"))
        tagged = from_table(s.sites.withColumn("info", F.map_concat(F.map_filter("info", lambda k, _: k != tag), F.create_map(F.lit(tag), column))), s.samples)
        out = annotate_variants(tagged, [coding.annotate_synonymy], fasta=fasta, cds=cds).sites.orderBy("site_id").collect()
        assert [r["info"]["Synonymy"] for r in out] == want
        assert [r["info"]["Synonymy_Info"] == "." for r in out] == [w == "." for w in want]


def test_outgroups_judge_whole_alleles_and_keep_sampled_sites(spark):
    rows = [
        (0, "1", 1, "AT", ["GC"], [[0, 0], [1, 1]], None, False, True, False, False, False, False, {}),  # AT against GC
        (1, "1", 2, "TA", ["AT"], [[0, 1], [0, 0]], None, False, True, False, False, False, False, {}),  # a tie: the first allele
        (2, "1", 3, "A", [], [[0, 0], [-1, -1]], None, False, False, False, False, False, True, {}),
    ]
    s = from_table(spark.createDataFrame(rows, SITES), ["in", "out"])
    kept = filter_variants(s, [filters.DeviantOutgroupFilter(["out"], keep_monomorphic=False)]).sites
    assert sorted(r["site_id"] for r in kept.collect()) == [1, 2]


def test_codons_span_coding_sequences_on_both_strands(spark):
    #            1234567890123456
    sequence = "CCATGAAACCTTGTAA"
    fasta = spark.createDataFrame([("1", sequence)], "contig string, seq string")
    # forward: exon 3-5 + exon 11-13 joined as ATG|TTG; the second one starts one base into a codon
    cds = spark.createDataFrame([("1", 3, 6, "+", 0, "t", 0), ("1", 11, 13, "+", 2, "t", 1)], "seqid string, start bigint, end bigint, strand string, phase int, parent string, file_order bigint")
    rows = snps([6, 11, 12], sequence)
    df = coding.with_codons(source(spark, rows).sites, filters.Context(NAMES, fasta=fasta, cds=cds)).orderBy("site_id").collect()
    assert [(r["_codon"], r["_place"]) for r in df] == [("ATT", 0), ("ATT", 1), ("ATT", 2)]
    back = spark.createDataFrame([("1", 3, 8, "-", 0, "t", 0)], "seqid string, start bigint, end bigint, strand string, phase int, parent string, file_order bigint")
    df = coding.with_codons(source(spark, snps([8, 7, 3], sequence)).sites, filters.Context(NAMES, fasta=fasta, cds=back)).orderBy("site_id").collect()
    assert [(r["_codon"], r["_place"]) for r in df] == [("TTT", 0), ("TTT", 1), ("CAT", 2)]


def test_cpg_context_and_coding_filter(spark, coding_tables):
    fasta, cds = coding_tables
    rows = snps([1, 10, 11, 18])
    s = source(spark, [*rows, rows[0] | {"site_id": 9, "pos": 500}])
    got = filter_variants(s, [filters.CpGFilter()], fasta=fasta).sites
    assert sorted(r["pos"] for r in got.collect()) == [1, 18, 500]
    got = filter_variants(s, [filters.CodingSequenceFilter()], cds=cds).sites
    assert sorted(r["pos"] for r in got.collect()) == [1, 10, 11, 18]
    context = strata.BaseContext()
    ctx = filters.Context(NAMES, fasta=fasta)
    labels = {r["pos"]: r["l"] for r in context.prepare(s.sites, ctx).withColumn("l", context.label(ctx)).collect()}
    assert labels == {1: None, 10: "TCG", 11: "CGT", 18: None, 500: None}


VCF = """##fileformat=VCFv4.2
##contig=<ID=1,length=1000>
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb
1\t10\t.\tA\tT\t.\t.\tAA=A;DB\tGT:DP\t0|1:3\t./.:1
1\t20\t.\tA\t.\t.\t.\t.\tGT\t0/0\t0
1\t30\t.\tAC\tA,<DEL>\t.\t.\t.\tGT\t1/2\t0/0
"""


def test_vcf_round_trip(spark, tmp_path):
    s = read_vcf(spark, write(tmp_path / "x.vcf", VCF))
    rows = s.sites.orderBy("site_id").collect()
    assert s.samples == ["a", "b"] and s.contig_lengths == {"1": 1000}
    assert [r["gt"] for r in rows] == [[[0, 1], [-1, -1]], [[0, 0], [0]], [[1, 2], [0, 0]]]
    assert rows[0]["info"] == {"AA": "A", "DB": "true"} and [r["is_snp"] for r in rows] == [True, False, False]
    assert s.sites.orderBy("site_id").select(genotype_strings().alias("g")).first()["g"] == ["A|T", "./."]
    write_vcf(s, str(tmp_path / "out.vcf"))
    again = read_vcf(spark, str(tmp_path / "out.vcf"))
    pick = ("pos", "ref", "alt", "gt", "phased", "info")
    assert [tuple(r[c] for c in pick) for r in again.sites.orderBy("site_id").collect()] == [tuple(r[c] for c in pick) for r in rows]
    assert from_table(s.sites.drop("is_snp", "is_mnp", "is_indel", "is_deletion", "is_sv", "is_dummy")).count() == 3


def test_chunks_and_bins(spark):
    sites = source(spark, random_sites(7, 50)).sites
    ctx = filters.Context(NAMES)
    c = strata.Chunked(4, width=16)
    counts = dict(c.prepare(sites, ctx).groupBy(c.label(ctx).alias("t")).count().collect())
    assert counts == {"chunk0": 13, "chunk1": 13, "chunk2": 12, "chunk3": 12}
    r = strata.RandomBin(3, seed=1)
    assert sites.select(r.label(ctx).alias("t")).distinct().count() <= 3


def test_target_sites(spark, coding_tables):
    fasta, _ = coding_tables
    rows = snps([4, 5, 6, 9, 12, 15])
    s = source(spark, [r | {"info": {"AA": r["ref"]}} for r in rows], {"1": 18})
    q = SpectrumQuery(s, 4, filters=[], fasta=fasta)
    q.opportunities, q.n_target_sites = sampled_opportunities(q, 500), 1000
    got = q.run().all
    assert np.isclose(got.n_sites, 1000)


# ---- ancestral inference


def enumerate_tree(base, outs, branches):
    """Sum over all bases of the internal nodes and of missing outgroups."""
    from itertools import product

    n, total = len(outs), 0.0
    for inner in product(range(4), repeat=n - 1):
        for tips in product(*([o] if o >= 0 else range(4) for o in outs)):
            if n == 1:
                total += branches[0][base, tips[0]]
                continue
            p = branches[0][base, inner[0]]
            for k in range(n - 1):
                p *= branches[2 * k + 1][inner[k], tips[k]]
                p *= branches[2 * k + 2][inner[k], inner[k + 1] if k + 1 < n - 1 else tips[-1]]
            total += p
    return total


@pytest.mark.parametrize("outs", [(0,), (1, 3), (2, -1), (0, 1, 2), (-1, 3, 0)])
def test_pruning_equals_enumeration(outs):
    rates = [0.1, 0.3, 0.2, 0.5, 0.05][: 2 * len(outs) - 1]
    for branches in ([ancestral.jc_matrix(r) for r in rates], [ancestral.k2_matrix(r, 3.0) for r in rates]):
        vector = ancestral.tree_vector(outs, branches)
        assert np.allclose(vector, [enumerate_tree(b, outs, branches) for b in range(4)])


def simulated_configs(model, n_sites=4000, seed=0):
    import pandas as pd

    rng = np.random.default_rng(seed)
    branches = model.branches()

    def step(b, k):
        p = branches[k][b] / branches[k][b].sum()
        return rng.choice(4, p=p)

    rows = []
    for _ in range(n_sites):
        base = int(rng.integers(4))
        node = step(base, 0)
        rows.append((base, -1, (int(step(node, 1)), int(step(node, 2))), model.n_ingroups, 1.0))
    df = pd.DataFrame(rows, columns=[*ancestral.CONFIG_KEY, "multiplicity"])
    return df.groupby(ancestral.CONFIG_KEY, as_index=False).sum()


def test_fit_recovers_rates():
    truth = ancestral.AncestralModel(6, 2, "JC", rates=[0.05, 0.1, 0.2])
    fitted = ancestral.AncestralModel(6, 2, "JC", prior=ancestral.kingman(6)).fit(simulated_configs(truth), n_runs=4)
    assert np.allclose(fitted.rates, truth.rates, atol=0.03)
    again = ancestral.AncestralModel.from_json(fitted.to_json())
    assert np.allclose(again.rates, fitted.rates) and np.allclose(again.prior, fitted.prior)


def test_ancestral_annotation(spark):
    rows = random_sites(8)
    s = source(spark, rows)
    configs = ancestral.site_configs(s.sites, [0, 1, 2, 3], [[4]], 4)
    weight = configs.groupBy("site_id").agg(F.sum("multiplicity").alias("w")).collect()
    assert all(abs(r["w"] - 1) < 1e-9 for r in weight)
    model = ancestral.AncestralModel(4, 1, "JC", prior=ancestral.kingman(4), rates=[0.1])
    out, _ = ancestral.annotate_likelihood(s.sites, [0, 1, 2, 3], [[4]], 4, model)
    assert {r["info"]["AA"] for r in out.collect()} <= {"A", "C", "G", "T", "."}
    pi = ancestral.adaptive_prior(ancestral.group_configs(configs), model)
    assert np.allclose(pi + pi[::-1], 1) and (pi >= 0).all()


def test_est_sfs_and_polydfe(spark, tmp_path):
    from helixframe.sources import formats

    path = write(tmp_path / "d.txt", "20,0,0,0 0,0,0,1 1,0,0,0\n3,0,17,0 0,0,1,0 0,0,0,0\n1,1,18,0 0,0,1,0 0,0,1,0\n")
    rows = formats.read_est_sfs(spark, path).orderBy("site_id").collect()
    assert [tuple(r)[1:5] for r in rows] == [(0, -1, [3, 0], 20), (2, 0, [2, -1], 17)]
    formats.write_est_sfs(formats.read_est_sfs(spark, path), 20, str(tmp_path / "e"))
    lines = [r[0] for r in spark.read.text(str(tmp_path / "e")).collect()]
    assert lines == ["20,0,0,0 0,0,0,1 1,0,0,0", "3,0,17,0 0,0,1,0 0,0,0,0"]
    got = formats.read_polydfe(spark, write(tmp_path / "p.txt", "1 1 4\n3 2 1 100\n5 4 3 200\n"))
    assert got["neutral"].to_list() == [94, 3, 2, 1, 0] and got["selected"].to_list() == [188, 5, 4, 3, 0]
