"""Command line: parse, filter, annotate."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from .. import __version__
from ..operators import ancestral, coding, filters, strata
from ..sources.reference import read_cds, read_fasta
from ..sources.vcz import open_sites
from .builder import SpectrumQuery, annotate_variants, filter_variants

STRATA = {"degeneracy": strata.Degeneracy, "synonymy": strata.Synonymy, "ancestral-base": strata.AncestralBase, "base-transition": strata.BaseTransition, "transition-transversion": strata.TransitionTransversion, "contig": strata.Contig}
FILTERS = {
    "snp": filters.SNPFilter, "snv": filters.SNVFilter, "poly-allelic": filters.PolyAllelicFilter, "biased-gc": filters.BiasedGCConversionFilter,
    "cpg": filters.CpGFilter, "coding": filters.CodingSequenceFilter, "deviant-outgroup": filters.DeviantOutgroupFilter, "existing-outgroup": filters.ExistingOutgroupFilter, "contig": filters.ContigFilter,
}
ANNOTATIONS = {"degeneracy": coding.annotate_degeneracy, "synonymy": coding.annotate_synonymy, "parsimony": ancestral.annotate_parsimony}


def csv_list(text: str) -> list[str]:
    return [x for x in text.split(",") if x]


def populations(text: str) -> dict[str, list[str]]:
    """A=s1,s2;B=s3"""
    out = {}
    for part in filter(None, text.split(";")):
        name, _, members = part.partition("=")
        if not name or not csv_list(members) or name in out:
            raise argparse.ArgumentTypeError(f"not a population: {part}")
        out[name] = csv_list(members)
    return out


def positive(text: str) -> int:
    if int(text) < 1:
        raise argparse.ArgumentTypeError("must be positive")
    return int(text)


def sample_size(text: str) -> list[int]:
    sizes = [int(x) for x in text.split(",")]
    if min(sizes) < 2:
        raise argparse.ArgumentTypeError("a sample size must be at least 2")
    return sizes


def lookup(table: dict, names: list[str], what: str) -> list:
    unknown = [n for n in names if n not in table]
    if unknown:
        raise SystemExit(f"unknown {what} {', '.join(unknown)}; choose from {', '.join(sorted(table))}")
    return [table[n] for n in names]


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="helixframe")
    parser.add_argument("--version", action="version", version=__version__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("parse", "filter", "annotate"):
        p = commands.add_parser(name)
        p.add_argument("--vcf", "--zarr", dest="vcf", required=True)
        p.add_argument("--output", required=True)
        p.add_argument("--fasta")
        p.add_argument("--gff")
        p.add_argument("--filter", type=csv_list, default=None)
        p.add_argument("--annotate", type=csv_list, default=[])
        p.add_argument("--contigs", type=csv_list)
        p.add_argument("--outgroups", type=csv_list, default=[])
        p.add_argument("--n-ingroups", type=positive, default=11)
        p.add_argument("--max-sites", type=positive)
        p.add_argument("--seed", type=int, default=0)
        if name == "parse":
            p.add_argument("--n", type=sample_size, required=True)
            p.add_argument("--pops", type=populations)
            p.add_argument("--stratify", type=csv_list, default=[])
            p.add_argument("--info-ancestral", default="AA")
            p.add_argument("--skip-non-polarized", action=argparse.BooleanOptionalAction, default=True)
            p.add_argument("--subsample-mode", choices=["probabilistic", "random"], default="probabilistic")
            p.add_argument("--two-sfs", action="store_true")
            p.add_argument("--two-sfs-distance", type=positive, default=1000)
            p.add_argument("--two-sfs-offset", type=int, default=0)
    return parser


def guard_output(output: str, source: str) -> None:
    """Refuse to write over, into or around the input."""
    a, b = os.path.realpath(output), os.path.realpath(source)
    if a == b or a.startswith(b + os.sep) or b.startswith(a + os.sep):
        raise SystemExit("the output would overwrite the input")


def make_filters(args) -> list[filters.Filter] | None:
    if args.filter is None and not args.contigs:
        return None
    out = []
    for cls in lookup(FILTERS, args.filter or [], "filter"):
        needs_outgroups = cls in (filters.DeviantOutgroupFilter, filters.ExistingOutgroupFilter)
        out.append(cls(args.outgroups) if needs_outgroups else cls(args.contigs or []) if cls is filters.ContigFilter else cls())
    if args.contigs and not any(isinstance(f, filters.ContigFilter) for f in out):
        out.append(filters.ContigFilter(args.contigs))
    return out


def make_annotations(args, samples: list[str]) -> list:
    out = []
    for name in args.annotate:
        if name == "maximum-likelihood":
            outs = [[samples.index(s)] for s in args.outgroups]
            inside = [i for i, s in enumerate(samples) if s not in args.outgroups]
            out.append(lambda df, ctx: ancestral.annotate_likelihood(df, inside, outs, args.n_ingroups, seed=args.seed)[0])
        else:
            out += lookup(ANNOTATIONS, [name], "annotation")
    return out


def run(args, spark: SparkSession) -> int:
    guard_output(args.output, args.vcf)
    source = open_sites(spark, args.vcf)
    tables = {"fasta": read_fasta(spark, args.fasta) if args.fasta else None, "cds": read_cds(spark, args.gff) if args.gff else None}
    if args.command == "filter":
        filter_variants(source, make_filters(args) or [], args.output, args.max_sites, **tables)
        return 0
    if args.command == "annotate":
        annotate_variants(source, make_annotations(args, source.samples), args.output, args.max_sites, {n: n for n in args.annotate}, **tables)
        return 0
    n = args.n[0] if len(args.n) == 1 else args.n
    result = SpectrumQuery(
        source, n, args.pops, [c() for c in lookup(STRATA, args.stratify, "stratification")], make_annotations(args, source.samples), make_filters(args), info_ancestral=args.info_ancestral, skip_non_polarized=args.skip_non_polarized,
        subsample_mode=args.subsample_mode, max_sites=args.max_sites, seed=args.seed, two_sfs=args.two_sfs, d=args.two_sfs_distance, two_sfs_offset=args.two_sfs_offset, **tables,
    ).run()
    if len(result) == 0 or result.is_empty():
        print("no sites: nothing was written", file=sys.stderr)
        return 1
    if args.pops or args.two_sfs:
        import json

        with open(args.output, "w") as f:
            json.dump({t: x.to_list() for t, x in result.to_dict().items()}, f)
    else:
        result.to_file(args.output)
    return 0


def main(argv: list[str] | None = None) -> int:
    args = build_parser().parse_args(argv)
    return run(args, SparkSession.builder.appName("helixframe").getOrCreate())


if __name__ == "__main__":
    sys.exit(main())
