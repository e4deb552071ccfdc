"""VCF-Zarr stores as a DataFrame of sites, and back.

Chunk files come through Spark's binary file reader, so a store can lie wherever Spark reads; the files
of one run of variants meet in one row and are decoded there. The writer numbers the sites, deals them
into runs as long as a chunk and writes each run's chunks in one task; a task that is run again writes the
same bytes. Metadata goes last, so that an unfinished store cannot be opened.
"""

from __future__ import annotations

import json
import math
import posixpath
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .vcf import VariantSource, read_vcf, with_classes, write_vcf
from .zarr import ArrayMeta, encode, metadata

# Fixed values of the format: markers of a missing entry and of padding, arrays that are no INFO field.
MISSING, PAD = -1, -2
FLOAT_PAD = {4: 0x7F800002, 8: 0x7FF0000000000002}
FLOAT_MISSING = np.array([0x7FF0000000000001], np.uint64).view(np.float64)[0]
RESERVED = {"variant_position", "variant_contig", "variant_allele", "variant_id", "variant_id_mask", "variant_quality", "variant_filter", "variant_length"}
CALLS = ("call_genotype", "call_genotype_phased")
RAW = "site_id long, chrom string, pos long, ref string, alt array<string>, gt array<array<int>>, phased array<boolean>, info map<string,string>"
CHUNK = re.compile(r"/([^/]+)/(?:c/)?([0-9]+(?:[./][0-9]+)*)$")


class _Folder:
    """Small files of a store, read on the driver through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.root = spark._jvm, path.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path("")) if s.isDirectory())

    def read(self, name: str) -> bytes | None:
        if not self.fs.exists(self._path(name)):
            return None
        stream = self.fs.open(self._path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def meta(self, name: str) -> ArrayMeta | None:
        text = self.read(f"{name}/.zarray") or self.read(f"{name}/zarr.json")
        return None if text is None or json.loads(text).get("node_type", "array") != "array" else ArrayMeta.parse(text)

    def vector(self, name: str) -> list:
        """A one-dimensional array that the driver may hold: names and lengths."""
        meta = self.meta(name)
        if meta is None:
            return []
        parts = [meta.decode(self.read(f"{name}/{k}") or self.read(f"{name}/c/{k}")) for k in range(math.ceil(meta.shape[0] / meta.chunks[0]))]
        return np.concatenate(parts)[: meta.shape[0]].tolist() if parts else []


def _entry(value, kind: str, width: int):
    """An INFO entry as text; None where it is missing, PAD where it is padding."""
    if kind in "UO":
        return PAD if value == "" else None if value == "." else str(value)
    if kind == "b":
        return "true" if value else None
    if kind == "f":
        if np.isnan(value):
            return PAD if int(value.view(f"u{width}")) == FLOAT_PAD.get(width) else None
        return str(value)
    return PAD if value == PAD else None if value == MISSING else str(int(value))


def _info(column: np.ndarray) -> list[str | None]:
    """The texts of one INFO array, several entries joined by commas; None for sites that lack the field."""
    kind, width = column.dtype.kind, column.dtype.itemsize
    if column.ndim == 1:
        found = [_entry(v, kind, width) for v in column]
        return [None if x == PAD else x for x in found]
    out = []
    for row in column:
        entries = [_entry(v, kind, width) for v in row]
        while entries and entries[-1] == PAD:
            entries.pop()
        entries = [None if e == PAD else e for e in entries]
        out.append(None if all(e is None for e in entries) else ",".join("." if e is None else e for e in entries))
    return out


def _nested(values: np.ndarray, keep: np.ndarray) -> pa.Array:
    """(sites, samples, ploidy) as lists of lists without padding."""
    inner = np.concatenate([[0], np.cumsum(keep.sum(2).ravel())]).astype(np.int32)
    outer = (np.arange(values.shape[0] + 1) * values.shape[1]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(outer), pa.ListArray.from_arrays(pa.array(inner), pa.array(values[keep].astype(np.int32))))


def _rows(arrays: dict[str, np.ndarray], contigs: list[str], first: int, samples: int) -> pa.RecordBatch:
    """Decoded runs of variants as rows; empty alleles go, and calls are numbered by the alleles that stay."""
    n = len(arrays["variant_position"])
    kept, recode = [], np.full((n, arrays["variant_allele"].shape[1] + 2), MISSING, np.int32)
    recode[:, -2] = PAD
    for i, row in enumerate(arrays["variant_allele"].tolist()):
        stay = [j for j, a in enumerate(row) if j == 0 or a not in ("", ".")]
        recode[i, stay] = range(len(stay))
        kept.append([row[j] for j in stay])
    nothing = pa.nulls(n, pa.list_(pa.list_(pa.int32()))), pa.nulls(n, pa.list_(pa.bool_()))
    gt, phased = nothing
    if "call_genotype" in arrays and samples:
        codes = arrays["call_genotype"].astype(np.int64)
        codes = np.where(codes < recode.shape[1] - 2, codes, MISSING)
        gt_codes = recode[np.arange(n)[:, None, None], codes]
        gt = _nested(gt_codes, gt_codes > PAD)
        marks = arrays.get("call_genotype_phased", np.zeros(codes.shape[:2], bool))
        phased = pa.ListArray.from_arrays(pa.array((np.arange(n + 1) * samples).astype(np.int32)), pa.array(marks.astype(bool).ravel()))
    info = [[] for _ in range(n)]
    for name, column in arrays.items():
        if name.startswith("variant_") and name not in RESERVED:
            for pairs, text in zip(info, _info(column), strict=True):
                if text is not None:
                    pairs.append((name[len("variant_") :], text))
    columns = [
        pa.array(range(first, first + n), pa.int64()), pa.array([contigs[c] for c in arrays["variant_contig"]], pa.string()), pa.array(arrays["variant_position"].astype(np.int64)), pa.array([a[0] for a in kept], pa.string()),
        pa.array([a[1:] for a in kept], pa.list_(pa.string())), gt, phased, pa.array(info, pa.map_(pa.string(), pa.string())),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in RAW.split(", ")])


def read_vcz(spark: SparkSession, path: str, rows: int = 512) -> VariantSource:
    """A store in the layout of vcf2zarr, formats 2 and 3; a task holds the chunks of one run of variants.

    A batch of the result has ``rows`` sites. INFO entries are text, as from a VCF; a flag is ``true``.
    """
    folder = _Folder(spark, path)
    metas = {k: m for k in folder.names() if k.startswith("variant_") or k in CALLS if (m := folder.meta(k)) is not None}
    if not {"variant_position", "variant_contig", "variant_allele"} <= set(metas):
        raise ValueError(f"{path} is no VCF-Zarr store")
    metas = {k: m for k, m in metas.items() if k in CALLS or k in RESERVED or len(m.shape) in (1, 2)}
    for k in ("variant_id", "variant_id_mask", "variant_quality", "variant_filter", "variant_length"):
        metas.pop(k, None)
    samples, contigs = folder.vector("sample_id"), folder.vector("contig_id")
    lengths = dict(zip(contigs, folder.vector("contig_length"), strict=False))
    lengths = {c: int(lengths[c]) if c in lengths and np.isfinite(lengths[c]) and lengths[c] > 0 else 0 for c in contigs}
    total, run = metas["variant_position"].shape[0], max(m.chunks[0] for m in metas.values())
    if any(run % m.chunks[0] for m in metas.values()):
        raise ValueError("chunk lengths along the variants must divide the longest")

    def decode(batches):
        for batch in batches:
            for row in batch.to_pylist():
                files = {(f["array"], f["chunk"]): f["content"] for f in row["files"] or []}
                first = row["run"] * run
                n = min(run, total - first)
                arrays = {}
                for name, meta in metas.items():
                    grid = [range(first // meta.chunks[0], -(-(first + n) // meta.chunks[0])), *(range(max(1, math.ceil(s / c))) for s, c in zip(meta.shape[1:], meta.chunks[1:], strict=True))]
                    whole = None
                    for at in np.ndindex(*map(len, grid)):
                        chunk = meta.decode(files.pop((name, ".".join(str(g[i]) for g, i in zip(grid, at, strict=True))), None))
                        if whole is None:
                            whole = np.empty([len(g) * c for g, c in zip(grid, meta.chunks, strict=True)], chunk.dtype)
                        if whole.dtype.kind == "U" and chunk.dtype.itemsize > whole.dtype.itemsize:
                            whole = whole.astype(chunk.dtype)
                        whole[tuple(slice(i * c, (i + 1) * c) for i, c in zip(at, meta.chunks, strict=True))] = chunk
                    arrays[name] = whole[tuple(slice(0, s) for s in (n, *meta.shape[1:]))]
                for lo in range(0, n, rows):
                    yield _rows({k: a[lo : lo + rows] for k, a in arrays.items()}, contigs, first + lo, len(samples))

    held = [f"{folder.root}/{k}" for k in metas]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(held).select("path", "content")
    place = F.regexp_extract("path", CHUNK.pattern, 2)
    files = files.where(place != "").select(F.regexp_extract("path", CHUNK.pattern, 1).alias("array"), F.replace(place, F.lit("/"), F.lit(".")).alias("chunk"), "content")
    length = F.element_at(F.create_map(*(F.lit(x) for k, m in metas.items() for x in (k, m.chunks[0]))), F.col("array"))
    runs = files.withColumn("run", F.floor(F.substring_index("chunk", ".", 1).cast("long") * length / run))
    gathered = runs.groupBy("run").agg(F.collect_list(F.struct("array", "chunk", "content")).alias("files"))
    df = spark.range(math.ceil(total / run)).withColumnRenamed("id", "run").join(gathered, "run", "left").mapInArrow(decode, RAW)
    return VariantSource(with_classes(df), samples, lengths)


def open_sites(spark: SparkSession, path: str) -> VariantSource:
    """The source a path names: a VCF-Zarr store by its ending, else VCF text."""
    if path.rstrip("/").endswith(".trees"):
        raise NotImplementedError("tree sequences are not read")
    return read_vcz(spark, path) if is_store(path) else read_vcf(spark, path)


def write_sites(source: VariantSource, path: str, info_headers: dict[str, str] | None = None) -> None:
    """Write ``source`` in the format that the ending of ``path`` names."""
    if path.rstrip("/").endswith(".trees"):
        raise ValueError("tree sequences are not written")
    write_vcz(source, path) if is_store(path) else write_vcf(source, path, info_headers)


def is_store(path: str) -> bool:
    return path.rstrip("/").endswith((".vcz", ".zarr"))


def numbered(sites: DataFrame, bucket: int = 1 << 20) -> DataFrame:
    """Add ``row``, the place of a site in site_id order; no window is longer than ``bucket``."""
    sites = sites.withColumn("bucket", F.floor(F.col("site_id") / bucket))
    starts = sites.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("start", F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).drop("n")
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("site_id"))
    return sites.withColumn("place", place).join(starts, "bucket").withColumn("row", F.col("start") + F.col("place") - 1).drop("bucket", "place", "start")


def _info_types(sites: DataFrame) -> dict[str, str]:
    """The narrowest type that gives back every entry of an INFO field: bool, int, float or text."""
    entry = sites.select(F.explode("info").alias("key", "value"))
    free = ~F.col("value").isin(str(MISSING), str(PAD))  # markers of integer arrays
    integer = F.col("value").rlike(r"^(0|-?[1-9][0-9]{0,8})$") & free
    number = F.col("value").rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$") & free
    rows = entry.groupBy("key").agg(F.min(F.col("value") == "true").alias("bool"), F.min(integer).alias("int"), F.min(number).alias("float")).collect()
    return {r["key"]: next((t for t in ("bool", "int", "float") if r[t]), "text") for r in sorted(rows)}


def write_vcz(source: VariantSource, path: str, variants: int = 10_000, samples: int = 1_000) -> None:
    """Write ``source`` as a VCF-Zarr store of format 2 with chunks of ``variants`` by ``samples``.

    ``path`` must be a folder that every task can write. A contig without a length gets its last position.
    A null genotype is missing in every sample. INFO fields take the narrowest type that holds all of
    them; a number keeps its value, not its spelling. Fields that hold -1 or -2 as integers stay text.
    """
    sites, spark = source.sites, source.sites.sparkSession
    n_samples = len(source.samples)
    variants = max(1, min(variants, (1 << 28) // max(1, n_samples)))
    size = sites.agg(F.count("*").alias("n"), F.max(F.size("alt")).alias("alts"), F.max(F.array_max(F.transform("gt", F.size))).alias("ploidy")).first()
    total, width, ploidy = size["n"], max(1, size["alts"] or 0) + 1, max(1, size["ploidy"] or 0)
    last = {r["chrom"]: r["last"] for r in sites.groupBy("chrom").agg(F.max("pos").alias("last")).collect()}
    contigs = [*source.contig_lengths, *sorted(set(last) - set(source.contig_lengths))]
    types = {k: t for k, t in _info_types(sites).items() if f"variant_{k}" not in RESERVED}
    kinds = {"bool": (np.dtype(bool), False), "int": (np.dtype("<i4"), MISSING), "float": (np.dtype("<f8"), FLOAT_MISSING), "text": (np.dtype(object), "")}
    coded = np.dtype("|i1" if width < 127 else "<i4")
    arrays = {
        "variant_contig": ((), np.dtype("<i4"), 0, []), "variant_position": ((), np.dtype("<i4"), 0, []), "variant_allele": ((width,), np.dtype(object), "", ["alleles"]),
        "variant_id": ((), np.dtype(object), ".", []), "variant_id_mask": ((), np.dtype(bool), True, []), "variant_quality": ((), np.dtype("<f4"), np.nan, []), "variant_filter": ((1,), np.dtype(bool), False, ["filters"]),
        **{f"variant_{k}": ((), *kinds[t], []) for k, t in types.items()},
    }
    if n_samples:
        arrays |= {"call_genotype": ((n_samples, ploidy), coded, PAD, ["samples", "ploidy"]), "call_genotype_phased": ((n_samples,), np.dtype(bool), False, ["samples"]), "call_genotype_mask": ((n_samples, ploidy), np.dtype(bool), True, ["samples", "ploidy"])}
    grids = {k: (variants, *(samples if d == "samples" else s for s, d in zip(shape, dims, strict=True))) for k, (shape, _, _, dims) in arrays.items()}
    number = {c: i for i, c in enumerate(contigs)}

    def put(name: str, at: tuple[int, ...], raw: bytes) -> None:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
        store.create_dir(posixpath.join(root, name), recursive=True)
        with store.open_output_stream(posixpath.join(root, name, ".".join(map(str, at)) if at else ""), compression=None) as f:
            f.write(raw)

    def put_array(name: str, values: np.ndarray, first: int) -> None:
        """Every chunk of one run of variants."""
        grid = grids[name]
        for at in np.ndindex(*(max(1, math.ceil(s / c)) for s, c in zip(values.shape[1:], grid[1:], strict=True))):
            part = values[(slice(None), *(slice(i * c, (i + 1) * c) for i, c in zip(at, grid[1:], strict=True)))]
            put(name, (first, *at), encode(part, grid, arrays[name][2]))

    def write_run(table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        n, run = table.num_rows, table.column("row")[0].as_py() // variants
        made = {k: np.full((n, *shape), fill, dtype) for k, (shape, dtype, fill, _) in arrays.items()}
        made["variant_contig"][:] = [number[c] for c in table.column("chrom").to_pylist()]
        made["variant_position"][:] = table.column("pos").to_pylist()
        for i, (ref, alt, pairs) in enumerate(zip(table.column("ref").to_pylist(), table.column("alt").to_pylist(), table.column("info").to_pylist(), strict=True)):
            made["variant_allele"][i, : 1 + len(alt or [])] = [ref or "", *(alt or [])]
            for k, v in pairs or []:
                if k in types and v is not None:
                    made[f"variant_{k}"][i] = {"bool": True, "int": v, "float": v, "text": v}[types[k]]
        if n_samples:
            for i in range(n):
                calls = table.column("gt")[i].as_py()
                if calls is None:
                    made["call_genotype"][i] = MISSING
                else:
                    for s, call in enumerate(calls):
                        made["call_genotype"][i, s, : len(call)] = call
                marks = table.column("phased")[i].as_py()
                if marks:
                    made["call_genotype_phased"][i, : len(marks)] = [bool(m) for m in marks]
            made["call_genotype_mask"][:] = made["call_genotype"] < 0
        for k, values in made.items():
            put_array(k, values, run)
        return pa.table({"run": pa.array([run], pa.int64()), "n": pa.array([n], pa.int64())})

    chosen = numbered(sites).select("row", "chrom", "pos", "ref", "alt", "gt", "phased", "info", F.floor(F.col("row") / variants).alias("run"))
    written = chosen.groupBy("run").applyInArrow(write_run, "run long, n long").agg(F.sum("n")).first()[0] or 0
    if written != total:
        raise RuntimeError(f"{written} of {total} sites written")

    for name, values in (("sample_id", source.samples), ("contig_id", contigs), ("filter_id", ["PASS"])):
        arrays[name], grids[name] = ((), np.dtype(object), "", []), (max(1, len(values)),)
        put(name, (0,), encode(np.array(values, object), grids[name], ""))
    arrays["contig_length"], grids["contig_length"] = ((), np.dtype("<i8"), 0, []), (max(1, len(contigs)),)
    put("contig_length", (0,), encode(np.array([source.contig_lengths.get(c) or last.get(c, 0) for c in contigs], np.int64), grids["contig_length"], 0))
    axis = {"sample_id": ("samples", n_samples), "contig_id": ("contigs", len(contigs)), "contig_length": ("contigs", len(contigs)), "filter_id": ("filters", 1)}
    for name, (shape, dtype, fill, dims) in arrays.items():
        lead, n = axis.get(name, ("variants", total))
        for file, text in zip((".zarray", ".zattrs"), metadata((n, *shape), grids[name], dtype, fill, [lead, *dims]), strict=True):
            put(name, (file,), text.encode())
    put("", (".zattrs",), json.dumps({"vcf_zarr_version": "0.4", "source": "helixframe"}).encode())
    put("", (".zgroup",), json.dumps({"zarr_format": 2}).encode())
