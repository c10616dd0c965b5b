"""Mosaic and slice-to-slice files: text to rows and back, file names, headers, checksums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F




def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line) of all text files below ``path``, each read whole."""
    t = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return t.select("path", F.posexplode(F.split("value", r"\r\n|\r|\n")).alias("line_no", "line"))


def mosaic_entries(lines: DataFrame) -> DataFrame:
    """(path, image, transform) from the lines (path, line_no, line) of mosaic files of either version; of equal names the last line wins."""
    w = Window.partitionBy("path").orderBy("line_no")
    l1, l2 = F.lead("line", 1).over(w), F.lead("line", 2).over(w)
    key = F.regexp_extract("line", r"^\s*image\s*:\s*(.*?)\s*$", 1)
    rows = lines.select("path", "line_no", "line", l1.alias("l1"), l2.alias("l2")).filter(F.col("line").rlike(r"^\s*image\s*:"))
    name = F.when(key != "", F.regexp_extract(key, r"^(\S+)", 1)).otherwise(F.trim("l1"))
    text = F.when(key != "", F.trim(F.regexp_replace(key, r"^\S+", ""))).otherwise(F.trim("l2"))
    base = F.substring_index(F.translate(name, "\\", "/"), "/", -1)
    one = rows.select("path", "line_no", base.alias("image"), text.alias("transform")).groupBy("path", "image").agg(F.max_by("transform", "line_no").alias("transform"))
    return one.select("path", "image", "transform")


def mosaic_header(lines: DataFrame) -> DataFrame:
    """(path, format_version, pixel_spacing, images) from the ``key: value`` lines of mosaic files."""
    kv = lines.select("path", F.lower(F.trim(F.regexp_extract("line", r"^\s*([A-Za-z_]+)\s*:", 1))).alias("k"), F.trim(F.regexp_extract("line", r":\s*(.*)$", 1)).alias("v"))
    pick = lambda k: F.max(F.when(F.col("k") == k, F.col("v").try_cast("int")))
    return kv.groupBy("path").agg(pick("format_version_number").alias("format_version"), pick("pixel_spacing").alias("pixel_spacing"), pick("number_of_images").alias("images"))


def mosaic_text(entries: DataFrame) -> DataFrame:
    """(path, text) of mosaic files, version 1, from (path, image, transform): sorted by image. A file's entries are gathered, files are not."""
    body = F.array_sort(F.collect_list(F.struct("image", "transform")))
    g = entries.groupBy("path").agg(body.alias("e"))
    lines = F.transform("e", lambda e: F.concat(F.lit("image:\n"), e["image"], F.lit("\n"), e["transform"]))
    head = F.concat(F.lit("format_version_number: 1\nnumber_of_images: "), F.size("e").cast("string"), F.lit("\npixel_spacing: 1\nuse_std_mask: 0\n"))
    return g.select("path", F.concat(head, F.array_join(lines, "\n")).alias("text"))


def stos_fields(lines: DataFrame) -> DataFrame:
    """Fields of slice-to-slice files by line: images 0 and 1, dimensions 4 and 5, transform 6, masks 8 and 9 where there are nine lines or more.

    A file of fewer than seven lines is invalid and left out.
    """
    g = lines.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l")).filter(F.size("l") >= 7)
    at = lambda i: F.trim(F.get("l", F.lit(i))["line"])
    nums = lambda i: F.transform(F.split(at(i), r"\s+"), lambda x: x.try_cast("double"))
    masked = F.size("l") >= 10
    return g.select("path", at(0).alias("control_image"), at(1).alias("mapped_image"), nums(4).alias("control_dims"), nums(5).alias("mapped_dims"), at(6).alias("transform"), F.when(masked, at(8)).alias("control_mask"), F.when(masked, at(9)).alias("mapped_mask"))


def stos_text(stos: DataFrame) -> DataFrame:
    """(path, text) of slice-to-slice files from the columns of ``stos_fields``, dimensions as ``1 1 w h``."""
    dims = lambda c: F.concat(F.lit("1 1 "), F.get(c, F.size(c) - 2).cast("bigint").cast("string"), F.lit(" "), F.get(c, F.size(c) - 1).cast("bigint").cast("string"))
    masks = F.when(F.col("control_mask").isNotNull(), F.concat(F.lit("\ntwo_user_supplied_masks:\n"), F.col("control_mask"), F.lit("\n"), F.col("mapped_mask"))).otherwise("")
    return stos.select("path", F.concat(F.concat_ws("\n", "control_image", "mapped_image", F.lit("0"), F.lit("0"), dims("control_dims"), dims("mapped_dims"), "transform"), masks).alias("text"))


def stos_name_fields(name: Column) -> dict[str, Column]:
    """Mapped and control section, channels, source and downsample of a file name; null where a part is missing."""
    part = lambda k: F.try_element_at(F.split(F.regexp_replace(name, r"\.[A-Za-z]+$", ""), "_"), F.lit(k))
    n = lambda p, i: F.nullif(F.regexp_extract(name, p, i), F.lit(""))
    return {
        "mapped_section": n(r"^(\d+)-(\d+)_", 1).try_cast("int"),
        "control_section": n(r"^(\d+)-(\d+)_", 2).try_cast("int"),
        "control_channel": n(r"_ctrl-([^_]+)", 1),
        "mapped_channel": n(r"_map-([^_]+)", 1),
        "method": F.when(part(-1).rlike(r"^\d+$"), part(-2)).otherwise(part(-1)),
        "name_downsample": part(-1).try_cast("int"),
    }


def mosaic_name_fields(path: Column) -> dict[str, Column]:
    """Section, channel, source and downsample of ``<section>_<channel>_<source>_..._<downsample>.mosaic``."""
    parts = F.split(F.regexp_replace(F.substring_index(F.translate(path, "\\", "/"), "/", -1), r"\.mosaic$", ""), "_")
    at = lambda k: F.try_element_at(parts, F.lit(k))
    return {"section": at(1).try_cast("int"), "channel": at(2), "source": at(3), "file_downsample": at(-1).try_cast("int")}


def compressed_numbers(text: Column) -> Column:
    """A transform's numbers in their shortest form: whole ones without a point, others without trailing zeros; exponents stay."""
    number = r"^[+-]?\d+\.\d+([eE][+-]?\d+)?$"
    short = lambda x: F.when(x.rlike(number), F.regexp_replace(F.regexp_replace(x, r"(\.\d*?)0+($|[eE])", "$1$2"), r"\.($|[eE])", "$1")).otherwise(x)
    return F.array_join(F.transform(F.split(text, r"\s+"), short), " ")


def checksums(entries: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, checksum): a digest of each group's texts that doesn't depend on their order or group size.

    Digests of the single texts are summed, as whole numbers, so groups are reduced where they lie.
    """
    h = F.conv(F.substring(F.md5(F.col(text)), 1, 12), 16, 10).cast("decimal(38,0)")
    return entries.groupBy(key).agg(F.count("*").alias("n"), F.sum(h).cast("string").alias("checksum"))


def histogram_lines(lines: DataFrame) -> DataFrame:
    """(path, intensity, n) from lines ``count: (a,b,c) #hex ...``; others are skipped."""
    m = r"^\s*(\d+)\s*:\s*\(\s*(\d+)"
    return lines.filter(F.col("line").rlike(m)).groupBy("path", F.regexp_extract("line", m, 2).try_cast("int").alias("intensity")).agg(F.sum(F.regexp_extract("line", m, 1).try_cast("bigint")).alias("n"))


def tile_ids(files: DataFrame, path: str) -> DataFrame:
    """(path, tile_id): the number a file's name consists of, else null."""
    name = F.regexp_extract(F.translate(F.col(path), "\\", "/"), r"([^/.]+)\.[^/.]*\s*$", 1)
    return files.select(F.col(path).alias("path"), name.try_cast("int").alias("tile_id"))


def best_records(records: DataFrame) -> DataFrame:
    """Heaviest alignment record per stos_id, flipped and not, then of both: flipped only if strictly heavier. Ties go to the lower record_id."""
    top = records.groupBy("stos_id", "flip").agg(F.max_by(F.struct("record_id", "peak_y", "peak_x", "weight", "angle", "flip"), F.struct("weight", (-F.col("record_id")).alias("o"))).alias("r"))
    both = top.groupBy("stos_id").agg(F.max_by("r", F.struct(F.col("r.weight"), ~F.col("flip"))).alias("r"))
    return both.select("stos_id", "r.record_id", "r.peak_y", "r.peak_x", "r.weight", "r.angle", "r.flip")


def heavier_than(records: DataFrame, percent: float, by: str, travel: float | None = None) -> DataFrame:
    """Records of each group whose weight exceeds the group's percentile, and whose peak lies within ``travel``."""
    cut = records.groupBy(by).agg(F.percentile("weight", percent).alias("cut"))
    kept = records.join(cut, by).filter(F.col("weight") > F.col("cut")).drop("cut")
    return kept if travel is None else kept.filter(F.col("peak_y") * F.col("peak_y") + F.col("peak_x") * F.col("peak_x") <= travel * travel)


def overridden(stos: DataFrame, args: dict[str, Column]) -> DataFrame:
    """Fields replaced by given values where those are not null."""
    return stos.withColumns({k: F.coalesce(v, F.col(k)) for k, v in args.items()})


