"""Readers of published files. Everything is read as text and parsed by domain rules; headers are checked first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.functions import pixels, units, values

#: cp1252 has a nil dash at byte 0x96, which ISO-8859-1 reads as this control character.
LATIN_DASH = "\u0096"

#: Lines before the first row of an ASCII raster.
HEAD = 6


def find_column(columns: list[str], pattern: str, whole: bool = False) -> str | None:
    """The first header that contains (or with ``whole`` begins with) a pattern, whatever the case."""
    return next((c for c in columns if (c.lower().startswith(pattern) if whole else pattern in c.lower())), None)


def scan_grid_csv(spark: SparkSession, path: str, columns: list[str], delimiter: str = ";", encoding: str = "UTF-8", missing: tuple[str, ...] = (), more: tuple[Column, ...] = ()) -> DataFrame:
    """grid_id, x, y and the requested columns as doubles; x and y come from centre columns, else from the id. ``more`` is taken along."""
    latin = encoding.lower() in ("cp1252", "windows-1252")
    raw = spark.read.option("sep", delimiter).option("encoding", "ISO-8859-1" if latin else encoding).option("header", True).csv(path)
    names = {c: c.lstrip("﻿") for c in raw.columns}
    absent = [c for c in columns if c not in names.values()]
    if absent:
        raise ValueError(f"{path} lacks {', '.join(absent)}; it has {', '.join(names.values())}")
    raw = raw.select(*[F.col(f"`{c}`").alias(name) for c, name in names.items()], *more)
    text = (lambda c: F.replace(F.col(c), F.lit(LATIN_DASH), F.lit("–"))) if latin else F.col
    grid, x, y = (find_column(list(names.values()), c, start) for c, start in (("gitter_id", False), ("x_mp", True), ("y_mp", True)))
    if grid is None and (x is None or y is None):
        raise ValueError(f"{path} has neither a grid id nor centre columns")
    gx, gy = values.grid_centroid(values.parse_grid_id(F.col(grid))) if grid else (F.lit(None).cast("double"),) * 2
    centre = lambda own, other: F.coalesce(values.parse_value(F.col(own)), other) if own else other
    key = F.col(grid) if grid else F.concat_ws(":", F.round(values.parse_value(F.col(x))).cast("long").cast("string"), F.round(values.parse_value(F.col(y))).cast("long").cast("string"))
    kept = [c for c in raw.columns if c not in names.values()]
    return raw.select(key.alias("grid_id"), centre(x, gx).alias("x"), centre(y, gy).alias("y"), *[values.parse_value(text(c), missing).alias(c) for c in columns], *kept)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): every line with a character of text files with its number in its file, from 0.

    Files are read in byte ranges, as Spark splits them. The lines of a range are counted, the counts before it are
    added to a line's place in it. One row for each range is sent to the tasks, as many as the driver plans anyway.
    """
    at = ["file", "_start"]
    raw = spark.read.text(path).filter(F.trim("value") != "").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"))
    raw = raw.withColumn("_id", F.monotonically_increasing_id())
    ranges = raw.groupBy(*at).agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1))
    placed = raw.join(F.broadcast(ranges.withColumn("_before", F.coalesce(before, F.lit(0)))), at)
    here = F.col("_id") - F.col("_first")
    known = F.assert_true((here >= 0) & (here < F.col("_n")), F.lit("the file changed while it was read"))
    return placed.withColumn("_known", known).filter("_known is null").select("file", (F.col("_before") + here).alias("line"), "value")


def scan_ascii_grid(spark: SparkSession, path: str, scale: float = 1.0, rows: tuple[int, int] | None = None) -> DataFrame:
    """(file, x, y, value) of each present cell of ESRI ASCII rasters; a row of the wrong width or a missing row is an error.

    An uncompressed raster is read in byte ranges by several tasks, a gzipped one by one task, which then deals out its
    rows. ``rows`` takes the rows from the first number to before the second, counted from the top; cells of other rows aren't parsed.
    """
    lines = numbered_lines(spark, path)
    part = F.split(F.trim("value"), r"\s+")
    entry = F.struct(F.lower(F.get(part, 0)), F.get(part, 1).cast("double"))
    head = lines.filter(F.col("line") < HEAD).groupBy("file").agg(F.map_from_entries(F.collect_list(entry)).alias("h"))
    count = lines.groupBy("file").agg((F.max("line") + 1 - HEAD).alias("_rows"))
    head = head.join(count, "file").select("file", "h", F.assert_true(F.col("_rows") == F.col("h")["nrows"].cast("long"), F.lit("the raster has another number of rows")).alias("_all"))
    body = lines.filter(F.col("line") >= HEAD).withColumn("r", F.col("line") - HEAD)
    body = body.filter(F.col("r").between(rows[0], rows[1] - 1)) if rows else body
    body = body.repartition("file", "r") if any(f.endswith(".gz") for f in spark.read.text(path).inputFiles()) else body
    body = body.join(F.broadcast(head), "file").filter("_all is null").withColumn("v", part)  # one row for each file
    width = F.assert_true(F.size("v") == F.col("h")["ncols"].cast("int"), F.lit("a row of the raster has the wrong width"))
    cells = body.select("file", "h", "r", width.alias("_ok"), F.posexplode("v").alias("c", "raw"))
    h = F.col("h")
    x, y = pixels.ascii_cell_centre(F.col("r"), F.col("c"), h["xllcorner"], h["yllcorner"], h["nrows"], h["cellsize"])
    value = F.when(F.col("raw").cast("double") != h["nodata_value"], F.col("raw").cast("double") * scale)
    return cells.select("file", x.alias("x"), y.alias("y"), value.alias("value"), "_ok").filter("value is not null and _ok is null").drop("_ok")


def scan_weights(spark: SparkSession, path: str, column: str, sep: str = ";", encoding: str = "UTF-8") -> DataFrame:
    """(grid_id, weight) of a second grid file; of repeated cells the last one with a value, in file order.

    Cells go by their grid id, those of a file without ids by ``x:y`` of their centres, as in ``scan_grid_csv``.
    Order is the file's name, then the place of the split in it, then the row. A cell's last row is found in each split
    first, by numbers alone, so that neither the rows nor the names of their files have to be sorted; one row for
    each cell and split is left.
    """
    at = F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_row")
    rows = scan_grid_csv(spark, path, [column], sep, encoding, more=at).filter(F.col(column).isNotNull())
    last = rows.groupBy("grid_id", "_file", "_start").agg(F.max_by(column, "_row").alias("_last"))
    return last.groupBy("grid_id").agg(F.max_by("_last", F.struct("_file", "_start")).alias("weight"))


def scan_unit_xml(spark: SparkSession, path: str, element: str = "EinheitWind", charset: str = "UTF-16") -> DataFrame:
    """Units of a register as typed columns; those without usable place or power are dropped."""
    fields = {"EinheitMastrNummer": "id", "Laengengrad": "lon", "Breitengrad": "lat", "Bruttoleistung": "kw", "Inbetriebnahmedatum": "commissioned", "DatumEndgueltigeStilllegung": "decommissioned", "EinheitBetriebsstatus": "status", "Lage": "lage"}
    schema = ", ".join(f"{f} string" for f in fields)
    raw = spark.read.format("xml").option("rowTag", element).option("charset", charset).option("ignoreNamespace", True).schema(schema).load(path)
    number = lambda c: values.parse_value(F.col(c))
    date = lambda c: F.try_to_date(F.substring(F.trim(c), 1, 10))
    typed = raw.select(
        F.col("EinheitMastrNummer").alias("id"), number("Laengengrad").alias("lon"), number("Breitengrad").alias("lat"), number("Bruttoleistung").alias("kw"),
        date("Inbetriebnahmedatum").alias("commissioned"), date("DatumEndgueltigeStilllegung").alias("decommissioned"), number("EinheitBetriebsstatus").cast("int").alias("status"), number("Lage").cast("int").alias("lage"),
    )
    return units.usable_units(typed)


def scan_polygons(spark: SparkSession, path: str, attribute: str, where: Column | None = None, limit: int | None = None) -> DataFrame:
    """(code, rings) of each polygon part of JSON or Parquet features; NULL geometry is skipped.

    ``rings`` of the result: ring 0 is the outer one. A multipolygon column is one array deeper.
    """
    rows = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.json(path)
    rows = rows.filter(where) if where is not None else rows
    rows = rows.limit(limit) if limit is not None else rows
    deep = rows.schema["polygons"].dataType.simpleString().count("array") == 3
    rows = rows.filter("polygons is not null").select(F.col(attribute).cast("string").alias("code"), (F.explode("polygons") if deep else F.col("polygons")).alias("rings"))
    return rows


def scan_rings(spark: SparkSession, path: str) -> DataFrame:
    """(region, ring, pos, x, y) of a boundary file {"rings": [[[lon, lat], ...], ...]}."""
    raw = spark.read.schema("rings array<array<array<double>>>").option("multiLine", True).json(path).select(F.col("_metadata.file_name").alias("region"), "rings")
    rings = raw.select("region", F.posexplode("rings").alias("ring", "points"))
    return rings.select("region", "ring", F.posexplode("points").alias("pos", "p")).select("region", "ring", "pos", F.get("p", 0).alias("x"), F.get("p", 1).alias("y"))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, size, mtime in ms) of all visible files below a folder; their content isn't read."""
    return listed(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, digest) of all visible files below a folder: SHA-256 of their bytes, taken in tasks. Files up to 2 GB, Spark's limit of one value."""
    return digested(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path))


def listed(found: DataFrame) -> DataFrame:
    """(path, name, size, mtime in ms) of files as rows of the binaryFile source, read from a folder or packed."""
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime"))


def digested(found: DataFrame) -> DataFrame:
    """(path, digest) of such rows."""
    return found.select("path", F.sha2("content", 256).alias("digest"))


#: Rows of the binaryFile source.
PACKED = "path string, modificationTime timestamp, length long, content binary"


def pack(rows: DataFrame, path: str) -> None:
    """Adds files given as (path, content) to a packed folder.

    A packed folder is Parquet with one row for each file, so that many small files cost no more than their bytes.
    """
    content = F.col("content").cast("binary")
    rows.select("path", F.current_timestamp().alias("modificationTime"), F.octet_length(content).cast("long").alias("length"), content.alias("content")).write.mode("append").parquet(path)


def unpacked(spark: SparkSession, path: str) -> DataFrame:
    """The files of a packed folder, as rows of the binaryFile source; what isn't selected isn't read."""
    return spark.read.schema(PACKED).parquet(path)


def union_same_schema(parts: list[DataFrame]) -> DataFrame:
    """Files of one vintage as one layer; differing fields are an error."""
    first = parts[0]
    for p in parts[1:]:
        if {f.name: f.dataType for f in p.schema} != {f.name: f.dataType for f in first.schema}:
            raise ValueError(f"fields differ: {first.columns} and {p.columns}")
    out = first
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=False)
    return out


CATALOGUE = "struct<items:array<struct<umm:struct<RelatedUrls:array<struct<Type:string,URL:string>>>>>>"


def flatten_catalogue(rows: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """(keep, name, url) of the data links to .h5 files in nested catalogue JSON."""
    parsed = rows.select(*keep, F.from_json(column, CATALOGUE).alias("j"))
    urls = parsed.select(*keep, F.explode("j.items").alias("i")).select(*keep, F.explode("i.umm.RelatedUrls").alias("u"))
    data = urls.filter((F.col("u.Type") == "GET DATA") & F.col("u.URL").endswith(".h5") & F.col("u.URL").startswith("https://"))
    return data.select(*keep, F.element_at(F.split("u.URL", "/"), -1).alias("name"), F.col("u.URL").alias("url"))


LAND = 9


def scan_admin_areas(features: DataFrame, expected: int | None = None) -> DataFrame:
    """Land features (name, gf, rings) -> name, n_points, west, south, east, north of rounded corners, by name."""
    point = features.filter(F.col("gf") == LAND).select("name", F.explode(F.flatten("rings")).alias("p"))
    point = point.select("name", F.round("p.x", 5).alias("x"), F.round("p.y", 5).alias("y"))
    out = point.groupBy("name").agg(F.count("*").alias("n_points"), F.min("x").alias("west"), F.min("y").alias("south"), F.max("x").alias("east"), F.max("y").alias("north"))
    if expected is not None and (n := out.count()) != expected:
        raise ValueError(f"{n} areas instead of {expected}")
    return out.orderBy("name")
