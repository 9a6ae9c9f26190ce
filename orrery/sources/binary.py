"""Binary formats as Python data sources and mapInArrow codecs: PLY, camera models, PFM, FLO and quantised splats."""

from __future__ import annotations

import itertools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Property types of PLY files.
PLY_TYPES = {"char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8", "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8"}

# Number of parameters of each camera model.
MODEL_PARAMS = {0: 3, 1: 4, 2: 4, 3: 5, 4: 8, 5: 8, 6: 12, 7: 5, 8: 4, 9: 5, 10: 12}

#: Rows of a file that encode writes, and that decode holds.
FILE_ROWS = 5000


def ply_header(data: bytes) -> tuple[str, int, list[tuple[str, str]], int]:
    """Format, vertex count, (name, type) of vertex properties, and where the body starts."""
    end = data.index(b"end_header") + len(b"end_header")
    end = data.index(b"\n", end) + 1
    kind, count, props, element = "ascii", 0, [], None
    for line in data[:end].decode("ascii", "replace").splitlines():
        w = line.split()
        if w[:1] == ["format"]:
            kind = w[1]
        elif w[:1] == ["element"]:
            element = w[1]
            count = int(w[2]) if element == "vertex" else count
        elif w[:1] == ["property"] and element == "vertex":
            props.append((w[-1], w[1]))
    return kind, count, props, end


def ply_array(data: bytes) -> np.ndarray:
    kind, count, props, start = ply_header(data)
    order = ">" if "big" in kind else "<"
    dtype = np.dtype([(n, order + PLY_TYPES[t]) for n, t in props])
    if kind == "ascii":
        rows = [tuple(float(x) for x in line.split()) for line in data[start:].decode("ascii").splitlines()[:count]]
        return np.array(rows, dtype=np.dtype([(n, "f8") for n, _ in props]))
    return np.frombuffer(data, dtype, count, start)


def read_ply(spark: SparkSession, path: str) -> DataFrame:
    """(path, vertex, then the properties as doubles). The schema comes from the first file's header; numbered properties are sorted by number."""
    files = spark.read.format("binaryFile").load(path)
    head = files.select(F.substring("content", 1, 65536).alias("h")).first()
    if head is None:
        raise ValueError(f"no file in {path}")
    names = [n for n, _ in ply_header(bytes(head["h"]))[2]]
    stem = lambda n: (n.rstrip("0123456789"), int(n[len(n.rstrip("0123456789")) :] or -1))
    rest = sorted((n for n in names if n.startswith("f_rest_")), key=stem)
    names = [n for n in names if n not in rest] + rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a = ply_array(data)
                for k in range(0, len(a), 65536):
                    part = a[k : k + 65536]
                    cols = [pa.array([p] * len(part)), pa.array(np.arange(k, k + len(part)))] + [pa.array(part[n].astype(np.float64)) for n in names]
                    yield pa.RecordBatch.from_arrays(cols, names=["path", "vertex", *names])

    return files.select("path", "content").mapInArrow(run, "path string, vertex long, " + ", ".join(f"`{n}` double" for n in names))


def to_ply(rows: DataFrame, columns: list[str], order: str) -> DataFrame:
    """(content): one binary PLY file for each partition of rows sorted by order. Callers choose the partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.column_stack([c.to_numpy(zero_copy_only=False).astype("<f4") for c in b.columns]) for b in batches if b.num_rows]
        if parts:
            body = np.vstack(parts)
            head = "ply\nformat binary_little_endian 1.0\n" + f"element vertex {len(body)}\n" + "".join(f"property float {c}\n" for c in columns) + "end_header\n"
            yield pa.RecordBatch.from_arrays([pa.array([head.encode() + body.tobytes()], pa.binary())], names=["content"])

    return rows.sortWithinPartitions(order).select(*columns).mapInArrow(run, "content binary")


def decode(files: DataFrame, reader, schema: str) -> DataFrame:
    """Rows of binary files (path, content): reader yields tuples for one file's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows = iter(reader(data.as_py()))
                while some := list(itertools.islice(rows, FILE_ROWS)):
                    yield pa.RecordBatch.from_pylist(some, schema=out)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))
    return files.select("content").mapInArrow(run, schema)


def encode(rows: DataFrame, writer) -> DataFrame:
    """(content): files of FILE_ROWS rows at most; writer makes one file's bytes of a list of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, FILE_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array([writer(batch.slice(at, FILE_ROWS).to_pylist())], pa.binary())], names=["content"])

    return rows.mapInArrow(run, "content binary")


def decode_named(files: DataFrame, reader, key: str, schema: str) -> DataFrame:
    """decode for files (key, content), with the key in front of every row; key is the name and type of one column."""
    name, kind = key.split()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if rows := [{name: own} | row for row in reader(data)]:
                    yield pa.RecordBatch.from_pylist(rows, schema=out)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(f"{key}, {schema}"))
    return files.select(F.col(name).cast(kind).alias(name), "content").mapInArrow(run, f"{key}, {schema}")


def images_to_pfm(pixels: DataFrame, key: str) -> DataFrame:
    """(key, content): a PFM file of each image's pixels (key, x, y, value); pixels without a value are 0. A row holds one image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = []
            for held in batch.column(1).to_pylist():
                a = np.zeros((max(p["y"] for p in held) + 1, max(p["x"] for p in held) + 1), "f4")
                a[[p["y"] for p in held], [p["x"] for p in held]] = [p["value"] for p in held]
                files.append(bytes_of_pfm(a))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.binary())], names=[key, "content"])

    return pixels.groupBy(key).agg(F.collect_list(F.struct("x", "y", "value")).alias("held")).mapInArrow(run, f"`{key}` {dict(pixels.dtypes)[key]}, content binary")


def cameras_of(data: bytes) -> Iterator[dict]:
    (n,), at = struct.unpack_from("<Q", data), 8
    for _ in range(n):
        camera, model, width, height = struct.unpack_from("<iiQQ", data, at)
        k = MODEL_PARAMS[model]
        params = struct.unpack_from(f"<{k}d", data, at + 24)
        at += 24 + 8 * k
        yield {"camera_id": camera, "model": model, "width": width, "height": height, "params": list(params)}


def bytes_of_cameras(rows: list[dict]) -> bytes:
    out = [struct.pack("<Q", len(rows))]
    for r in rows:
        out.append(struct.pack(f"<iiQQ{len(r['params'])}d", r["camera_id"], r["model"], r["width"], r["height"], *r["params"]))
    return b"".join(out)


def points_of(data: bytes) -> Iterator[dict]:
    (n,), at = struct.unpack_from("<Q", data), 8
    for _ in range(n):
        point, x, y, z, r, g, b, error, length = struct.unpack_from("<QdddBBBdQ", data, at)
        at += struct.calcsize("<QdddBBBdQ")
        track = struct.unpack_from(f"<{2 * length}i", data, at)
        at += 8 * length
        yield {"point_id": point, "x": x, "y": y, "z": z, "r": r, "g": g, "b": b, "error": error, "track": [{"image_id": i, "point2d_idx": j} for i, j in zip(track[::2], track[1::2], strict=True)]}


def bytes_of_points(rows: list[dict]) -> bytes:
    out = [struct.pack("<Q", len(rows))]
    for p in rows:
        flat = [v for t in p["track"] for v in (t["image_id"], t["point2d_idx"])]
        out.append(struct.pack(f"<QdddBBBdQ{len(flat)}i", p["point_id"], p["x"], p["y"], p["z"], p["r"], p["g"], p["b"], p["error"], len(p["track"]), *flat))
    return b"".join(out)


def images_of(data: bytes) -> Iterator[dict]:
    (n,), at = struct.unpack_from("<Q", data), 8
    for _ in range(n):
        image, *pose, camera = struct.unpack_from("<i7di", data, at)
        at += struct.calcsize("<i7di")
        stop = data.index(b"\0", at)
        name, at = data[at:stop].decode(), stop + 1
        (k,), at = struct.unpack_from("<Q", data, at), at + 8
        flat = struct.unpack_from("<" + "ddq" * k, data, at)
        at += 24 * k
        yield {"image_id": image, "qvec": list(pose[:4]), "tvec": list(pose[4:]), "camera_id": camera, "name": name, "obs": [{"x": x, "y": y, "point3d_id": p} for x, y, p in zip(flat[::3], flat[1::3], flat[2::3], strict=True)]}


def bytes_of_images(rows: list[dict]) -> bytes:
    out = [struct.pack("<Q", len(rows))]
    for r in rows:
        out.append(struct.pack("<i7di", r["image_id"], *r["qvec"], *r["tvec"], r["camera_id"]) + r["name"].encode() + b"\0" + struct.pack("<Q", len(r["obs"])))
        out += [struct.pack("<ddq", o["x"], o["y"], o["point3d_id"]) for o in r["obs"]]
    return b"".join(out)


def disparity_rows(a: np.ndarray) -> Iterator[dict]:
    for y in range(a.shape[0]):
        for x in range(a.shape[1]):
            yield {"x": x, "y": y, "value": float(a[y, x])}


def png_of(data: bytes, divisor: float) -> Iterator[dict]:
    """Disparities of a grey PNG of 8 or 16 bits: values over the divisor; 0 becomes infinite."""
    import zlib

    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, body = 8, []
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        if kind == b"IHDR":
            w, h, depth, colour, _, _, interlaced = struct.unpack_from(">IIBBBBB", data, at + 8)
        elif kind == b"IDAT":
            body.append(data[at + 8 : at + 8 + size])
        at += 12 + size
    if colour != 0 or depth not in (8, 16) or interlaced:
        raise ValueError("only grey images of 8 or 16 bits, not interlaced, hold disparities")
    step = depth // 8
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(h, 1 + w * step)
    out, above = np.zeros((h, w * step), np.uint8), np.zeros(w * step, np.int64)
    for y in range(h):
        line, kind = lines[y, 1:].astype(np.int64), lines[y, 0]
        if kind == 2:
            line = (line + above) & 255
        elif kind == 1:
            line = (np.cumsum(line.reshape(-1, step), 0) & 255).reshape(-1)
        elif kind in (3, 4):
            for k in range(len(line)):
                left, up, corner = (line[k - step], above[k], above[k - step]) if k >= step else (0, above[k], 0)
                guess = left + up - corner
                nearest = min((abs(guess - left), 0, left), (abs(guess - up), 1, up), (abs(guess - corner), 2, corner))[2]
                line[k] = (line[k] + ((left + up) // 2 if kind == 3 else nearest)) & 255
        out[y], above = line, line
    a = out.view(">u2" if step == 2 else np.uint8).astype(np.float32) / divisor
    yield from disparity_rows(np.where(a == 0, np.inf, a))


def bytes_of_png(a: np.ndarray) -> bytes:
    """A grey PNG of 16 bits."""
    import zlib

    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = np.concatenate((np.zeros((a.shape[0], 1), np.uint8), a.astype(">u2").view(np.uint8).reshape(a.shape[0], -1)), 1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 16, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def npy_of(data: bytes) -> Iterator[dict]:
    """Disparities of an NPY array as they are."""
    import io

    yield from disparity_rows(np.load(io.BytesIO(data), allow_pickle=False))


def hdf5_of(data: bytes) -> Iterator[dict]:
    """Disparities of an HDF5 file's dataset `disparity`; what is no number becomes infinite. Needs h5py where it runs."""
    import io

    import h5py

    a = np.asarray(h5py.File(io.BytesIO(data), "r")["disparity"], np.float32)
    yield from disparity_rows(np.where(np.isnan(a), np.inf, a))


def pfm_of(data: bytes) -> Iterator[dict]:
    """Pixels of a PFM image from its top left; what is not above 0 becomes infinite."""
    kind, size, scale, body = data.split(b"\n", 3)
    w, h = map(int, size.split())
    n = 3 if kind.strip() == b"PF" else 1
    a = np.frombuffer(body, ("<" if float(scale) < 0 else ">") + "f4", w * h * n).reshape(h, w, n)[::-1, :, 0]
    for y in range(h):
        for x in range(w):
            yield {"x": x, "y": y, "value": float(a[y, x]) if a[y, x] > 0 else float("inf")}


def flo_of(data: bytes) -> Iterator[dict]:
    magic, w, h = struct.unpack_from("<fii", data)
    if magic != 202021.25:
        raise ValueError("not a flow file")
    a = np.frombuffer(data, "<f4", w * h * 2, 12).reshape(h, w, 2)
    for y in range(h):
        for x in range(w):
            yield {"x": x, "y": y, "u": float(a[y, x, 0]), "v": float(a[y, x, 1])}


def bytes_of_pfm(a: np.ndarray) -> bytes:
    return b"Pf\n%d %d\n-1.0\n" % (a.shape[1], a.shape[0]) + a[::-1].astype("<f4").tobytes()


def bytes_of_flo(a: np.ndarray) -> bytes:
    return struct.pack("<fii", 202021.25, a.shape[1], a.shape[0]) + a.astype("<f4").tobytes()


def quantised(rows: DataFrame) -> DataFrame:
    """Splats with colour, opacity and rotation in bytes and the key that they are sorted by, largest first: volume times opacity."""
    byte = lambda x: F.floor(F.least(F.greatest(x, F.lit(0.0)), F.lit(255.0))).cast("int")
    key = (F.exp("s0") + F.exp("s1") + F.exp("s2")) / (1 + F.exp(-F.col("opacity")))
    n = F.sqrt(sum((F.col(q) ** 2 for q in ("qw", "qx", "qy", "qz")), F.lit(0.0)))
    turn = {f"b{q}": byte(F.col(q) / n * 128 + 128) for q in ("qw", "qx", "qy", "qz")}
    colour = {f"b{k}": byte((F.lit(0.5) + 0.28209479177387814 * F.col(k)) * 255) for k in ("c0", "c1", "c2")}
    return rows.withColumns({"key": key, **colour, **turn, "balpha": byte(255 / (1 + F.exp(-F.col("opacity"))))})
