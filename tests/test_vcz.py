"""VCF-Zarr stores: round trips, hand-made stores, the codecs of their chunks."""

import gzip
import json
import struct
import zlib

import numpy as np
import pytest

from helixframe.functions.genotypes import SITES
from helixframe.plans.builder import SpectrumQuery, filter_variants
from helixframe.plans.cli import build_parser
from helixframe.sources import zarr
from helixframe.sources.vcf import VariantSource
from helixframe.sources.vcz import open_sites, read_vcz, write_vcz
from test_sites import NAMES, random_sites, source

PICK = ("chrom", "pos", "ref", "alt", "gt", "info", "is_snp")


def plain(s, pick=PICK):
    return [tuple(r[c] for c in pick) for r in s.sites.orderBy("site_id").collect()]


@pytest.mark.parametrize(("variants", "samples"), [(10_000, 1_000), (7, 2), (50, 3), (150, 1)])
def test_round_trip(spark, tmp_path, variants, samples):
    s = source(spark, random_sites(3), {"1": 9000, "2": 8000})
    write_vcz(s, str(tmp_path / "x.vcz"), variants, samples)
    again = read_vcz(spark, str(tmp_path / "x.vcz"), rows=11)
    assert again.samples == NAMES and again.contig_lengths == {"1": 9000, "2": 8000}
    assert plain(again) == plain(s)
    assert [r["site_id"] for r in again.sites.orderBy("site_id").collect()] == list(range(150))
    assert SpectrumQuery(again, 4).run().to_dict().keys() == SpectrumQuery(s, 4).run().to_dict().keys()
    assert np.allclose(SpectrumQuery(again, 4).run().all.to_list(), SpectrumQuery(s, 4).run().all.to_list())


def test_rows_of_a_filter_and_sparse_site_ids(spark, tmp_path):
    rows = random_sites(4)
    for r in rows:
        r["site_id"] = r["site_id"] % 3 * (1 << 33) + r["site_id"] * 7
    s = VariantSource(spark.createDataFrame(rows, SITES), NAMES, {})
    kept = filter_variants(s, [], str(tmp_path / "f.zarr"))
    again = open_sites(spark, str(tmp_path / "f.zarr"))
    assert plain(again) == plain(kept) and again.contig_lengths == {c: max(r["pos"] for r in rows if r["chrom"] == c) for c in ("1", "2")}


def test_ragged_calls_info_types_nulls_and_no_rows(spark, tmp_path):
    base = {"chrom": "1", "ref": "A", "alt": ["T"], "phased": None, "is_snp": True, "is_mnp": False, "is_indel": False, "is_deletion": False, "is_sv": False, "is_dummy": False}
    rows = [
        {**base, "site_id": 0, "pos": 5, "gt": [[0, 1], [1]], "phased": [True, False], "info": {"F": "true", "I": "12", "D": "0.25", "T": "x,.,y", "Neg": "-1"}},
        {**base, "site_id": 1, "pos": 6, "alt": [], "gt": [[-1, 0], [-1, -1, 0]], "info": {}},
        {**base, "site_id": 2, "pos": 7, "gt": None, "info": {"I": "0", "D": "3", "T": "é"}},
    ]
    write_vcz(VariantSource(spark.createDataFrame(rows, SITES), ["a", "b"]), str(tmp_path / "r.vcz"))
    got = read_vcz(spark, str(tmp_path / "r.vcz")).sites.orderBy("site_id").collect()
    assert [r["gt"] for r in got] == [[[0, 1], [1]], [[-1, 0], [-1, -1, 0]], [[-1, -1, -1], [-1, -1, -1]]]
    assert [r["info"] for r in got] == [{"F": "true", "I": "12", "D": "0.25", "T": "x,.,y", "Neg": "-1"}, {}, {"I": "0", "D": "3.0", "T": "é"}]
    assert got[0]["phased"] == [True, False] and [r["alt"] for r in got] == [["T"], [], ["T"]]
    write_vcz(VariantSource(spark.createDataFrame([], SITES), ["a"], {"1": 10}), str(tmp_path / "e.vcz"))
    empty = read_vcz(spark, str(tmp_path / "e.vcz"))
    assert empty.count() == 0 and empty.samples == ["a"] and empty.contig_lengths == {"1": 10}


def put(root, name, values, chunks, codecs, kind):
    """An array of format 3; chunks that hold zeros only are left out."""
    (root / name).mkdir(parents=True)
    meta = {"zarr_format": 3, "node_type": "array", "shape": values.shape, "data_type": kind, "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": chunks}}, "codecs": codecs, "fill_value": "" if kind == "string" else 0}
    (root / name / "zarr.json").write_text(json.dumps(meta))
    for at in np.ndindex(*(-(-s // c) for s, c in zip(values.shape, chunks, strict=True))):
        part = values[tuple(slice(i * c, (i + 1) * c) for i, c in zip(at, chunks, strict=True))]
        if kind == "string":
            full = np.full(chunks, "", object)
        else:
            full = np.zeros(chunks, values.dtype)
            if not part.any():
                continue
        full[tuple(slice(0, n) for n in part.shape)] = part
        raw = zarr.packed_strings([v.encode() for v in full.ravel()]) if kind == "string" else full.tobytes()
        file = root / name / "c" / "/".join(map(str, at))
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(gzip.compress(raw) if any(c["name"] == "gzip" for c in codecs) else raw)


def test_format_three_with_absent_chunks_and_empty_alleles(spark, tmp_path):
    root = tmp_path / "v3.zarr"
    number, text = [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "gzip"}], [{"name": "vlen-utf8"}]
    put(root, "variant_position", np.array([3, 9, 12, 20, 21], np.int32), [2], number, "int32")
    put(root, "variant_contig", np.array([0, 0, 0, 0, 1], np.int8), [2], number, "int8")
    put(root, "variant_allele", np.array([["A", "T", ""], ["C", "", "G"], ["G", ".", "."], ["T", "C", "A"], ["A", "AT", ""]], object), [4, 2], text, "string")
    put(root, "call_genotype", np.array([[[0, 1], [1, -2]], [[0, 2], [1, 1]], [[0, 0], [-1, 0]], [[2, 1], [0, 0]], [[1, 1], [0, 1]]], np.int8), [2, 1, 2], number, "int8")
    put(root, "variant_AC", np.array([[1, -2], [-1, 4], [-2, -2], [-1, -1], [5, 6]], np.int16), [2, 2], number, "int16")
    put(root, "sample_id", np.array(["x", "y"], object), [1], text, "string")
    put(root, "contig_id", np.array(["1", "2"], object), [2], text, "string")
    s = read_vcz(spark, str(root))
    got = s.sites.orderBy("site_id").collect()
    assert [(r["chrom"], r["pos"], r["ref"], r["alt"]) for r in got] == [("1", 3, "A", ["T"]), ("1", 9, "C", ["G"]), ("1", 12, "G", []), ("1", 20, "T", ["C", "A"]), ("2", 21, "A", ["AT"])]
    assert [r["gt"] for r in got] == [[[0, 1], [1]], [[0, 1], [-1, -1]], [[0, 0], [-1, 0]], [[2, 1], [0, 0]], [[1, 1], [0, 1]]]
    assert [r["info"] for r in got] == [{"AC": "1"}, {"AC": ".,4"}, {}, {}, {"AC": "5,6"}]
    assert s.samples == ["x", "y"] and s.contig_lengths == {"1": 0, "2": 0}


def blosc(data, width, block, whole):
    """A Blosc buffer of zlib parts with shuffled bytes."""
    blocks, starts, at = [], [], 16 + 4 * -(-len(data) // block)
    for lo in range(0, len(data), block):
        part = data[lo : lo + block]
        n = len(part) // width
        part = np.frombuffer(part[: n * width], np.uint8).reshape(n, width).T.tobytes() + part[n * width :]
        k = 1 if whole or len(part) < block else width
        step = len(part) // k
        out = b"".join(struct.pack("<I", len(z)) + z for z in (zlib.compress(part[i * step : (i + 1) * step]) for i in range(k)))
        starts.append(at)
        at += len(out)
        blocks.append(out)
    return struct.pack("<BBBBIII", 2, 1, 1 | 3 << 5 | (16 if whole else 0), width, len(data), block, at) + struct.pack(f"<{len(starts)}I", *starts) + b"".join(blocks)


@pytest.mark.parametrize("whole", [True, False])
def test_codecs(whole):
    data = np.random.default_rng(1).integers(0, 50, 3001).astype("<i4").tobytes()
    assert zarr.blosc(blosc(data, 4, 4096, whole)) == data
    assert zarr.blosc(struct.pack("<BBBBIII", 2, 1, 2, 4, 8, 8, 24) + b"abcdefgh") == b"abcdefgh"
    with pytest.raises(NotImplementedError):
        zarr.decompress(b"", "pcodec")
    values = np.array(["", "é", "abc"], object)
    meta = zarr.ArrayMeta.parse(zarr.metadata((3,), (4,), values.dtype, "", ["x"])[0])
    assert meta.decode(zarr.encode(values, (4,), "")).tolist() == ["", "é", "abc", ""]


def test_wrong_stores(spark, tmp_path):
    (tmp_path / "n.vcz" / "variant_x").mkdir(parents=True)
    with pytest.raises(ValueError, match="VCF-Zarr"):
        read_vcz(spark, str(tmp_path / "n.vcz"))
    with pytest.raises(NotImplementedError):
        open_sites(spark, "x.trees")
    assert build_parser().parse_args(["filter", "--zarr", "a.vcz", "--output", "b.vcz"]).vcf == "a.vcz"
