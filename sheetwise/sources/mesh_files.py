"""Mesh and point files as Spark sources and sinks: STL, OBJ, PLY, GOCAD TSurf, NPZ, whitespace text.

Readers take any path that Spark can list (`binaryFile`), one file a row, and parse
inside the executors; results are the tables of `operators.mesh` plus the file path.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwise.operators.mesh import CORNERS

TRIANGLES = "path string, face_id bigint, " + ", ".join(f"{c} double" for c in CORNERS) + ", n0 double, n1 double, n2 double"
_RECORD = np.dtype([("n", "<f4", 3), ("v", "<f4", (3, 3)), ("extra", "<u2")])


def is_binary_stl(data: bytes) -> bool:
    """By length if the face count fits it, else by the word that begins a text file."""
    if len(data) < 84:
        return False
    return 84 + 50 * int.from_bytes(data[80:84], "little") == len(data) or not data.lstrip()[:5].lower() == b"solid"


def parse_stl(data: bytes) -> tuple[np.ndarray, np.ndarray | None]:
    """(corners (F, 3, 3), normals or None); a file that looks binary but is too short for its count is tried as text first."""
    found = None
    if is_binary_stl(data):
        told, whole = int.from_bytes(data[80:84], "little"), (len(data) - 84) // 50
        rows = np.frombuffer(data, _RECORD, count=min(told, whole), offset=84)
        found = rows["v"].astype(float), rows["n"].astype(float)
        if told <= whole:
            return found
    corners, normals = [], []
    for line in data.decode("utf-8", "replace").splitlines():
        part = line.split()
        words = [x.lower() for x in part[:2]]
        try:
            if words[:1] == ["vertex"] and len(part) >= 4:
                corners.append([float(x) for x in part[1:4]])
            elif words == ["facet", "normal"] and len(part) >= 5:
                normals.append([float(x) for x in part[2:5]])
        except ValueError:
            continue
    corners = corners[: len(corners) // 3 * 3]
    if not corners:
        if found is None or not len(found[0]):
            raise ValueError("no whole triangle in the file")
        return found
    return np.array(corners).reshape(-1, 3, 3), np.array(normals) if len(normals) * 3 == len(corners) else None


def parse_obj(data: bytes) -> tuple[np.ndarray, np.ndarray | None]:
    """(corners (F, 3, 3), normals or None).

    Polygons become fans; a negative index counts from the last vertex so far. Faces may
    come before their vertices. Normals are those of all faces, or None where a corner has none.
    """
    at, vn, polygons = [], [], []
    for line in data.decode("utf-8", "replace").splitlines():
        part = line.split()
        if part[:1] == ["v"]:
            at.append([float(x) for x in part[1:4]])
        elif part[:1] == ["vn"]:
            vn.append([float(x) for x in part[1:4]])
        elif part[:1] == ["f"]:
            ref = [(p.split("/") + ["", ""])[:3] for p in part[1:]]
            index = lambda x, n: int(x) - 1 if int(x) > 0 else n + int(x)
            polygons.append([(index(r[0], len(at)), index(r[2], len(vn)) if r[2] else None) for r in ref])
    fans = [(p[0], p[k], p[k + 1]) for p in polygons for k in range(1, len(p) - 1)]
    if not fans:
        raise ValueError("no face in the file")
    corners = np.array([[at[v] for v, _ in fan] for fan in fans], float)
    if not vn or any(m is None for fan in fans for _, m in fan):
        return corners, None
    mean = np.array([np.mean([vn[m] for _, m in fan], axis=0) for fan in fans])
    return corners, mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)


def _binary_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def read_triangles(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Triangles of all STL and OBJ files under the path, with their normals (null where the file has none)."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for where, data in zip(pdf["path"], pdf["content"]):
                ending = kind or where.rsplit(".", 1)[-1].lower()
                if ending not in ("stl", "obj"):
                    raise ValueError(f"no mesh format {ending}")
                v, n = (parse_stl if ending == "stl" else parse_obj)(bytes(data))
                out = pd.DataFrame(v.reshape(-1, 9), columns=CORNERS)
                out.insert(0, "face_id", np.arange(len(out)))
                out.insert(0, "path", where)
                for k in range(3):
                    out[f"n{k}"] = n[:, k] if n is not None else np.nan
                yield out

    rows = _binary_files(spark, path).mapInPandas(parse, TRIANGLES)
    return rows.withColumns({f"n{k}": F.when(~F.isnan(f"n{k}"), F.col(f"n{k}")) for k in range(3)})


_PLY = {"char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8", "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8"}


def parse_ply(data: bytes) -> pd.DataFrame:
    """Scalar properties of the vertex element, which must come first; text or binary of either byte order."""
    end = data.index(b"end_header\n") + len(b"end_header\n")
    lines = [x.split() for x in data[:end].decode("ascii").splitlines()]
    form = next(x[1] for x in lines if x[:1] == ["format"])
    elements = [x for x in lines if x[:1] == ["element"]]
    if elements[0][1] != "vertex":
        raise ValueError("the vertex element must come first")
    n, props, own = int(elements[0][2]), [], False
    for x in lines:
        if x[:1] == ["element"]:
            own = x[1] == "vertex"
        elif x[:1] == ["property"] and own:
            if x[1] == "list":
                raise ValueError("vertices with lists are not read")
            props.append((x[2], _PLY[x[1]]))
    if form == "ascii":
        rows = np.loadtxt(io.BytesIO(data[end:]), max_rows=n, ndmin=2)
        return pd.DataFrame(rows[:, : len(props)], columns=[p for p, _ in props])
    order = "<" if "little" in form else ">"
    return pd.DataFrame({p: a.astype(float) for (p, _), a in zip(props, (np.frombuffer(data, np.dtype([(q, order + k) for q, k in props]), n, end)[q] for q, _ in props))})


def parse_npz(data: bytes) -> pd.DataFrame:
    """points, and tangents, normals and singular_mask where the file has them; an .npy file holds points alone."""
    got = np.load(io.BytesIO(data), allow_pickle=False)
    arrays = {"points": got} if isinstance(got, np.ndarray) else dict(got)
    out = pd.DataFrame(arrays["points"].reshape(-1, arrays["points"].shape[-1])).add_prefix("x")
    for name, short in (("tangents", "u"), ("normals", "n")):
        if name in arrays:
            out = out.join(pd.DataFrame(arrays[name].reshape(len(out), -1)).add_prefix(short))
    if "singular_mask" in arrays:
        out["singular"] = arrays["singular_mask"].reshape(-1).astype(float)
    return out


def _read_points(spark: SparkSession, path: str, parse: Callable[[bytes], pd.DataFrame], columns: dict[str, str]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for where, data in zip(pdf["path"], pdf["content"]):
                rows = parse(bytes(data))
                out = pd.DataFrame({"path": where, "i": np.arange(len(rows))})
                for c, source in columns.items():
                    names = [s for s in source.split("|") if s in rows]
                    out[c] = rows[names[0]].to_numpy(float) if names else np.nan
                yield out

    schema = "path string, i bigint, " + ", ".join(f"{c} double" for c in columns)
    rows = _binary_files(spark, path).mapInPandas(run, schema)
    return rows.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})


def read_ply(spark: SparkSession, path: str) -> DataFrame:
    """(path, i, x0..x2, n0..n2)."""
    return _read_points(spark, path, parse_ply, {"x0": "x", "x1": "y", "x2": "z", "n0": "nx|normal_x", "n1": "ny|normal_y", "n2": "nz|normal_z"})


def read_npz(spark: SparkSession, path: str, dim: int = 3, frame: int = 3) -> DataFrame:
    """(path, i, x.., u.., n.., singular) of NPZ and NPY files."""
    names = [f"x{k}" for k in range(dim)] + [f"u{k}" for k in range(frame)] + [f"n{k}" for k in range(dim)] + ["singular"]
    return _read_points(spark, path, parse_npz, {c: c for c in names})


def read_text_points(spark: SparkSession, path: str) -> DataFrame:
    """(x0..x2, n0..n2, u, v) of `x y z nx ny nz [u v]` lines with finite numbers and a normal."""
    part = F.split(F.trim("value"), r"\s+")
    names = ["x0", "x1", "x2", "n0", "n1", "n2", "u", "v"]
    rows = spark.read.text(path).select(*[F.try_element_at(part, F.lit(k + 1)).try_cast("double").alias(c) for k, c in enumerate(names)])
    finite = " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c}) AND abs({c}) < double('infinity')" for c in names[:6])
    return rows.where(finite).where("n0*n0 + n1*n1 + n2*n2 > 1e-16")


def read_tsurf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of GOCAD TSurf text."""
    part = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).select(part.alias("p"))
    vertices = lines.where(F.col("p")[0].isin("VRTX", "PVRTX")).select(F.col("p")[1].cast("bigint").alias("vertex_id"), *[F.col("p")[k + 2].cast("double").alias(f"x{k}") for k in range(3)])
    faces = lines.where(F.col("p")[0] == "TRGL").select(*[F.col("p")[k + 1].cast("bigint").alias(c) for k, c in enumerate("abc")])
    return vertices, faces.select(F.monotonically_increasing_id().alias("face_id"), "a", "b", "c")


def write_ply(points: DataFrame, path: str) -> None:
    """One text PLY file in the folder `path`: the header is the first row of a single ordered partition."""
    n = points.count()
    head = "ply\nformat ascii 1.0\nelement vertex %d\nproperty float x\nproperty float y\nproperty float z\nend_header" % n
    body = points.select(F.col("i").alias("o"), F.concat_ws(" ", "x0", "x1", "x2").alias("value"))
    first = points.sparkSession.createDataFrame([(-1, head)], "o bigint, value string")
    # a PLY file is one file; its rows pass through one ordered task
    first.unionByName(body).repartition(1).sortWithinPartitions("o").select("value").write.text(path)


def write_text_points(points: DataFrame, path: str, columns: list[str]) -> None:
    points.select(F.concat_ws(" ", *[F.format_string("%.10g", F.col(c)) for c in columns]).alias("value")).write.text(path)


def stl_bytes(corners: np.ndarray) -> bytes:
    """Binary STL of (F, 3, 3) corners."""
    rows = np.zeros(len(corners), _RECORD)
    n = np.cross(corners[:, 1] - corners[:, 0], corners[:, 2] - corners[:, 0])
    rows["n"], rows["v"] = n / np.maximum(np.linalg.norm(n, axis=1, keepdims=True), 1e-12), corners
    return bytes(80) + len(rows).to_bytes(4, "little") + rows.tobytes()
