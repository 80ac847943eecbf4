"""Sources and sinks of files: panoramas, arrays, annotation trees, problems as text, archives.

Listing and bytes come from Spark's binaryFile source, so any store that Spark reads will do; what is inside is decoded
on the executors, one file a row.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, modificationTime, length, content) of all files below a folder, but for empty ones; columns that are not used are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)


def scenes(listing: DataFrame, digits: int | None = None) -> DataFrame:
    """(scene_id): the all-digit directories, or those of exactly so many digits, in the order of strings."""
    names = listing.select(F.explode(F.split("path", "/")).alias("scene_id"))
    return names.where(paths.is_scene(F.col("scene_id"), digits)).distinct().orderBy("scene_id")


def panoramas(listing: DataFrame) -> DataFrame:
    """(scene_id, file, floor_id, room_id, pano_id, path) of files named as panoramas, below `<scene>/panos/`."""
    parts = F.split("path", "/")
    named = listing.select("path", paths.basename(F.col("path")).alias("file"), F.try_element_at(parts, F.lit(-3)).alias("scene_id"))
    ids = paths.pano_ids(F.col("file"))
    return named.select("scene_id", "file", *ids, "path").where("pano_id is not null").where(paths.is_scene(F.col("scene_id")))


def images(listing: DataFrame) -> DataFrame:
    """Files with a `.jpg` or `.png` suffix, as they are spelled."""
    return listing.where(F.endswith("path", F.lit(".jpg")) | F.endswith("path", F.lit(".png")))


def pixels(spark: SparkSession, folder: str) -> DataFrame:
    """(path, height, width, row, col, b, g, r, grey) of decoded images. A grey image has one value as all three colours,
    a fourth channel is not read, and a file that is no image gives one row with nulls but for its path."""
    image = spark.read.format("image").load(folder).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")
    image = image.withColumn("at", F.explode_outer(F.expr("if(nChannels > 0, sequence(0, height * width - 1), null)")))
    byte = lambda k: F.ascii(F.decode(F.substring(F.col("data"), (F.expr("at * nChannels + 1") + F.expr(f"if(nChannels = 1, 0, {k})")).cast("int"), F.lit(1)), "ISO-8859-1"))
    size = lambda c: F.when(F.col("nChannels") > 0, F.col(c)).alias(c)
    found = image.select(F.col("origin").alias("path"), size("height"), size("width"), F.expr("cast(at div width as int)").alias("row"), F.expr("cast(at % width as int)").alias("col"), *(F.when(F.col("at").isNotNull(), byte(k)).alias(c) for k, c in enumerate("bgr")))
    return found.withColumn("grey", F.expr("0.299D * r + 0.587D * g + 0.114D * b"))


def arrays(listing: DataFrame) -> DataFrame:
    """(path, row, col, value) of one- and two-dimensional `.npy` files; a vector is one column. NaN and infinity are null."""

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                found = np.load(io.BytesIO(content), allow_pickle=False)
                found = found.reshape(len(found), -1) if found.ndim else found.reshape(1, 1)
                row, col = np.indices(found.shape)
                value = found.ravel().astype(float)
                yield pd.DataFrame({"path": path, "row": row.ravel(), "col": col.ravel(), "value": pd.array(np.where(np.isfinite(value), value, np.nan), dtype="Float64")})

    return listing.select("path", "content").mapInPandas(step, "path string, row int, col int, value double")


def archive_members(listing: DataFrame, keep: str = ".*") -> DataFrame:
    """(path, member, content) of the members of zip files whose names match, without unpacking the others."""

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        if re.search(keep, name) and not name.endswith("/"):
                            yield pd.DataFrame({"path": [path], "member": [name], "content": [z.read(name)]})

    return listing.select("path", "content").mapInPandas(step, "path string, member string, content binary")


def corners(spark: SparkSession, path: str) -> DataFrame:
    """(x, y) from lines of two numbers between spaces."""
    return spark.read.csv(path, sep=" ", schema="x double, y double").where("x is not null and y is not null")


def bundle_problem(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(observations, cameras, points) of a bundle-adjustment problem as text.

    A header `cameras points observations`, then a line `camera point u v` for each observation, then nine numbers a
    camera (r1 r2 r3 t1 t2 t3 f k1 k2) and three a point, one on a line.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\s+$", ""), r"\n")).alias("at", "line"))
    fields = lines.select("at", F.split(F.trim("line"), r"\s+").alias("f"))
    head = fields.where("at = 0").select(*(F.get("f", F.lit(k)).try_cast("int").alias(n) for k, n in enumerate(("n_cams", "n_pts", "n_obs"))))
    body = fields.where("at > 0").crossJoin(F.broadcast(head))  # one row by the format
    obs = body.where("at <= n_obs").select(*(F.get("f", F.lit(k)).try_cast(t).alias(n) for k, (n, t) in enumerate((("cam_id", "int"), ("pt_id", "int"), ("u", "double"), ("v", "double")))))
    rest = body.where("at > n_obs").select((F.col("at") - F.col("n_obs") - 1).alias("k"), F.get("f", F.lit(0)).try_cast("double").alias("x"), "n_cams")
    cams = rest.where("k < 9 * n_cams").withColumn("j", F.expr("cast(k % 9 as int)")).groupBy(F.expr("cast(k div 9 as int)").alias("cam_id")).pivot("j", list(range(9))).agg(F.first("x"))
    cams = cams.toDF("cam_id", "r1", "r2", "r3", "t1", "t2", "t3", "f", "k1", "k2")
    past = rest.where("k >= 9 * n_cams").withColumn("k", F.expr("k - 9 * n_cams")).withColumn("j", F.expr("cast(k % 3 as int)"))
    points = past.groupBy(F.expr("cast(k div 3 as int)").alias("pt_id")).pivot("j", [0, 1, 2]).agg(F.first("x")).toDF("pt_id", "x", "y", "z")
    return obs, cams, points


_NUMBER = "try_variant_get({0}, '{1}', 'double')"


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """(path, floor_id, complete_id, partial_id, pano_id, image, rotation, tx, ty, tz, scale, layout) from annotation trees.

    The tree is merger -> floor -> complete room -> partial room -> panorama, with other values beside the rooms. Ids are
    the keys' suffixes. A translation is a list of two or three numbers or an object x, y, z; what is missing is 0.
    """
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.parse_json("value").alias("doc"))
    levels = (("floor", "floor_"), ("complete", "complete_room_"), ("partial", "partial_room_"), ("pano", "pano_"))
    found = text.selectExpr("path", "try_variant_get(doc, '$.merger', 'variant') as node")
    kept = ["path"]
    for name, prefix in levels:
        found = spark.sql(f"select t.*, e.key as {name}_key, e.value as child from {{tree}} t, lateral variant_explode(t.node) e where startswith(e.key, '{prefix}')", tree=found)
        kept.append(f"{name}_key")
        found = found.select(*kept, F.col("child").alias("node"))
    ids = [paths.key_suffix(F.col(f"{n}_key")).alias(f"{n}_id") for n, _ in levels]
    pose = "$.floor_plan_transformation"
    place = [F.coalesce(*(F.expr(_NUMBER.format("node", f"{pose}.translation{p}")) for p in (f"[{k}]", f".{a}")), F.lit(0.0)).alias(f"t{a}") for k, a in enumerate("xyz")]
    layout = lambda kind, part: F.expr(f"try_variant_get(node, '$.{kind}.{part}', 'array<array<double>>')").alias(part)
    return found.select(
        "path",
        *ids,
        F.expr("try_variant_get(node, '$.image_path', 'string')").alias("image"),
        F.coalesce(F.expr(_NUMBER.format("node", f"{pose}.rotation")), F.lit(0.0)).alias("rotation"),
        *place,
        F.expr(_NUMBER.format("node", f"{pose}.scale")).alias("scale"),
        layout("layout_complete", "vertices"),
        *(layout("layout_complete", part) for part in ("doors", "windows", "openings")),
    )


def vertices(tree: DataFrame) -> DataFrame:
    """(path, pano_id, seq, x, y) of every layout's corners."""
    return tree.select("path", "pano_id", F.posexplode("vertices").alias("seq", "v")).select("path", "pano_id", "seq", F.col("v")[0].alias("x"), F.col("v")[1].alias("y"))


def elements(tree: DataFrame, kind: str) -> DataFrame:
    """(path, pano_id, element, x0, y0, x1, y1) of doors, windows or openings: three entries each, left, right and one unread.

    A list whose length is not divisible by three has no elements.
    """
    listed = tree.where(F.size(kind) % 3 == 0).where(F.size(kind) > 0)
    count = F.expr(f"explode(sequence(0, size({kind}) div 3 - 1))").alias("element")
    one = lambda k, j: F.col(kind)[F.col("element") * 3 + k][j]
    return listed.select("path", "pano_id", kind, count).select("path", "pano_id", "element", one(0, 0).alias("x0"), one(0, 1).alias("y0"), one(1, 0).alias("x1"), one(1, 1).alias("y1"))


def pano_of(tree: DataFrame, pano_id: str | Column) -> DataFrame:
    """The first panorama with an id, in the order of floors and rooms, of each tree."""
    order = F.struct("floor_id", "complete_id", "partial_id")
    best = tree.where(F.col("pano_id") == pano_id).groupBy("path").agg(F.min_by(F.struct(*tree.columns), order).alias("r"))
    return best.select("r.*")


def floor_plan_points(spark: SparkSession, number: int, per_edge: int, sigma: float = 0.0, seed: int = 0) -> DataFrame:
    """(plan, edge, i, x, y): points along a fixed polygon's edges, both ends included, with Gaussian noise."""
    # fixed values of the three plans
    plans = {
        1: [(0, 0), (10, 0), (10, 10), (0, 10)],
        2: [(0, 0), (10, 0), (10, 10), (5, 15), (0, 10)],
        3: [(0, 0), (10, 0), (10, 10), (-3, 10), (-3, 5), (0, 5)],
    }
    corners_ = plans[number]
    edges = [(k, *map(float, a), *map(float, b)) for k, (a, b) in enumerate(zip(corners_, corners_[1:] + corners_[:1]))]
    table = spark.createDataFrame(edges, "edge int, ax double, ay double, bx double, by double")
    dots = table.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(per_edge - 1)))).withColumn("t", F.col("i") / max(1, per_edge - 1))
    noise = lambda k: sigma * F.randn(seed + k) if sigma else F.lit(0.0)
    return dots.select(F.lit(number).alias("plan"), "edge", "i", (F.expr("ax + (bx - ax) * t") + noise(0)).alias("x"), (F.expr("ay + (by - ay) * t") + noise(1)).alias("y"))


def setting(text: str, overrides: dict[str, object] | None = None) -> dict:
    """Settings from lines `key: value`, nested by indentation; overrides have keys joined by dots and go over them.

    Values are JSON where they can be (numbers, lists, true, null, quoted strings), and else strings; `#` starts a comment.
    """
    out: dict = {}
    levels: list[tuple[int, dict]] = [(-1, out)]
    for line in text.splitlines():
        line = re.sub(r"(^|\s)#.*$", "", line).rstrip()
        if not line.strip():
            continue
        indent, (name, _, value) = len(line) - len(line.lstrip()), line.strip().partition(":")
        while levels[-1][0] >= indent:
            levels.pop()
        if value.strip():
            try:
                levels[-1][1][name] = json.loads(value)
            except ValueError:
                levels[-1][1][name] = value.strip()
        else:
            levels[-1][1][name] = {}
            levels.append((indent, levels[-1][1][name]))
    for path, value in (overrides or {}).items():
        *parents, last = path.split(".")
        node = out
        for name in parents:
            node = node.setdefault(name, {})
        node[last] = value
    return out


def cached(spark: SparkSession, folder: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table in the folder, made and written there the first time that it is asked for."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        make().write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)


def write_arrays(cells: DataFrame, keys: list[str], folder: str) -> DataFrame:
    """Sink of `.npy` files: one two-dimensional array for each key of cells (keys, row, col, value); missing cells are NaN.

    Gives (keys, file, rows, cols), on reading which the files are written; a file's name is that of its key's values.
    """
    kinds = dict(cells.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "file string, rows int, cols int"])

    def step(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        from pyarrow.fs import FileSystem

        found = np.full((int(rows["row"].max()) + 1, int(rows["col"].max()) + 1), np.nan)
        found[rows["row"], rows["col"]] = rows["value"]
        data = io.BytesIO()
        np.save(data, found)
        system, path = FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        name = "_".join(map(str, key)) + ".npy"
        with system.open_output_stream(f"{path}/{name}", compression=None) as f:
            f.write(data.getvalue())
        return pd.DataFrame([(*key, f"{folder}/{name}", *found.shape)], columns=[*keys, "file", "rows", "cols"])

    return cells.select(*keys, "row", "col", "value").groupBy(*keys).applyInPandas(step, schema)


def copied(manifest_: DataFrame) -> DataFrame:
    """(path, target, length): the files of a manifest copied to their targets, a file a row, on reading."""

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileSystem

        for batch in batches:
            sizes = []
            for path, target in zip(batch["path"], batch["target"]):
                source, name = FileSystem.from_uri(path.replace("file:/", "file:///", 1) if re.match("file:/[^/]", path) else path)
                with source.open_input_stream(name, compression=None) as f:
                    data = f.read()
                system, name = FileSystem.from_uri(target)
                system.create_dir(name.rpartition("/")[0], recursive=True)
                with system.open_output_stream(name, compression=None) as f:
                    f.write(data)
                sizes.append(len(data))
            yield pd.DataFrame({"path": batch["path"], "target": batch["target"], "length": sizes})

    return manifest_.select("path", "target").mapInPandas(step, "path string, target string, length long")


def write_points(points: DataFrame, folder: str) -> None:
    """Sink of point clouds: Parquet, a folder for each scene and panorama."""
    points.write.mode("overwrite").partitionBy("scene_id", "pano_id").parquet(folder)


def write_text(rows: DataFrame, folder: str, *columns: str) -> None:
    """Sink of text lists: the columns between spaces, a line for each row."""
    rows.select(F.concat_ws(" ", *columns)).write.mode("overwrite").text(folder)


def manifest(panos: DataFrame, root: str) -> DataFrame:
    """(path, target): where each kept panorama belongs in a subset's tree. A table stands in for links between files."""
    return panos.select("path", F.concat_ws("/", F.lit(root), "scene_id", F.lit("panos"), "file").alias("target"))
