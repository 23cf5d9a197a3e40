"""NPZ and NPY files of single clouds, and the conversion of folders of meshes into them."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwise.sources.mesh_files import parse_obj, parse_stl

#: Rows that a file of one cloud may hold: it is written by the driver.
MOST = 5_000_000


def encode_params(params: dict) -> dict[str, np.ndarray]:
    """Parameters as arrays of a file: nothing, one array, or a tuple of arrays."""
    value = params.get("params")
    if value is None:
        return {"params_kind": np.array("none")}
    if isinstance(value, tuple):
        return {"params_kind": np.array("tuple"), "params_count": np.array(len(value))} | {f"params_{k}": np.asarray(v) for k, v in enumerate(value)}
    return {"params_kind": np.array("array"), "params": np.asarray(value)}


def decode_params(file) -> object:
    """What encode_params() wrote; files without it have none."""
    names = set(file.keys())
    kind = str(file["params_kind"]) if "params_kind" in names else "array" if "params" in names else "none"
    if kind == "tuple":
        return tuple(file[f"params_{k}"] for k in range(int(file["params_count"])))
    return file["params"] if kind == "array" else None


def _put(path: str, data: bytes) -> None:
    fs, at = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    with fs.open_output_stream(at) as f:
        f.write(data)


def cloud_bytes(arrays: dict[str, np.ndarray], npy: bool = False, compress: bool = True) -> bytes:
    out = io.BytesIO()
    if npy:
        np.save(out, arrays["points"])
    else:
        (np.savez_compressed if compress else np.savez)(out, **arrays)
    return out.getvalue()


def save_cloud(points: DataFrame, path: str, x: Sequence[str], tangents: Sequence[str] = (), normals: Sequence[str] = (), params: Sequence[str] = (), singular: str | None = None, compress: bool = True, most: int = MOST) -> None:
    """One cloud in the order of i as an NPZ file, or its positions alone as an NPY file by the path's ending.

    Such a file has no parts, so its rows pass the driver, up to `most`; larger clouds are an error and belong in Parquet.
    """
    if (n := points.count()) > most:
        raise ValueError(f"{n} rows are too many for one file of a cloud")
    got = points.orderBy("i").select(*x, *tangents, *normals, *params, *([singular] if singular else [])).toPandas()
    arrays = {"points": got[list(x)].to_numpy(float)}
    arrays |= {name: got[list(cols)].to_numpy(float) for name, cols in (("tangents", tangents), ("normals", normals)) if cols}
    arrays |= encode_params({"params": tuple(got[c].to_numpy(float) for c in params)} if params else {})
    if singular:
        arrays["singular_mask"] = got[singular].to_numpy(bool)
        arrays["singular_indices"] = np.flatnonzero(arrays["singular_mask"])
    _put(path, cloud_bytes(arrays, path.endswith(".npy"), compress))


def find_clouds(spark: SparkSession, top: str, pattern: str = "*.npz") -> DataFrame:
    """(path, bytes) of all files under a folder, at any depth, whose name fits."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(top)
    return files.select("path", F.col("length").alias("bytes"))


def read_curvatures(spark: SparkSession, path: str) -> DataFrame:
    """(gauss, mean) of `K H` lines; others are left out."""
    parts = F.split(F.trim(F.col("value")), r"[\s,]+")
    both = spark.read.text(path).select(*[F.get(parts, k).try_cast("double").alias(n) for k, n in enumerate(("gauss", "mean"))])
    return both.where("gauss IS NOT NULL AND mean IS NOT NULL AND NOT isnan(gauss) AND NOT isnan(mean)")


def sampled(corners: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """n points of triangles (F, 3, 3) spread by area, and their unit normals; degenerate triangles get none."""
    cross = np.cross(corners[:, 1] - corners[:, 0], corners[:, 2] - corners[:, 0])
    size = np.linalg.norm(cross, axis=1)
    corners, cross, size = corners[size > 1e-12], cross[size > 1e-12], size[size > 1e-12]
    if not len(size):
        return np.zeros((0, 3)), np.zeros((0, 3))
    k = np.arange(n)
    face = np.searchsorted(np.cumsum(size) / size.sum(), (k + 0.5) / n).clip(0, len(size) - 1)
    s, r = np.sqrt(k * 0.6180339887498949 % 1)[:, None], (k * 0.7548776662466927 % 1)[:, None]
    a, b, c = (corners[face, v] for v in range(3))
    return (1 - s) * a + s * (1 - r) * b + s * r * c, cross[face] / size[face, None]


def batch_convert(spark: SparkSession, top: str, to: str, n: int) -> DataFrame:
    """(path, status, rows): every STL and OBJ file under a folder as an NPZ cloud of n points with normals in the folder `to`.

    One row a file; a file that can't be read gets its error as status and spoils no other.
    A cloud is named by its file's path below the top, with __ for /, so equal names in
    different folders stay apart; clouds of OBJ files keep that ending in their names.
    """
    root = urlparse(top).path.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{stl,obj,STL,OBJ}").load(top).select("path", "content")

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, data in zip(b["path"], b["content"]):
                try:
                    corners, _ = (parse_obj if path.lower().endswith(".obj") else parse_stl)(bytes(data))
                    p, normals = sampled(np.asarray(corners, float), n)
                    if not len(p):
                        raise ValueError("no triangle with an area")
                    below = urlparse(path).path.removeprefix(root).lstrip("/")
                    name = below.removesuffix(below[-4:]).replace("/", "__") + (".obj" if path.lower().endswith(".obj") else "")
                    _put(f"{to.rstrip('/')}/{name}.npz", cloud_bytes({"points": p, "normals": normals} | encode_params({})))
                    row = (path, "done", len(p))
                except (ValueError, IndexError, KeyError, UnicodeDecodeError, OSError, zipfile.BadZipFile) as e:
                    row = (path, f"failed: {e}", 0)
                yield pd.DataFrame([row], columns=["path", "status", "rows"])

    return files.mapInPandas(convert, "path string, status string, rows bigint")
