"""Sources: corpora, conversations, fixtures, images and settings as DataFrames; sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import MapType

LINE_PITCH, CHAR_SIZE, LEFT, TOP = 40, 20, 40, 100


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def document_lines(docs: DataFrame, *keep: str) -> DataFrame:
    """(page_id, line_no, text, confidence) of each line of documents, with columns of the documents to keep."""
    cut = F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line_no", "text")
    return docs.select(F.col("doc_id").alias("page_id"), *keep, cut).withColumn("confidence", F.lit(0.95))


def conversation_lines(turns: DataFrame) -> DataFrame:
    """Lines of conversations; a line's number counts on through all turns of its conversation, whatever their lengths."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    before = F.sum(F.size("_lines")).over(W.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(W.unboundedPreceding, -1))
    placed = turns.withColumn("_lines", lines).withColumn("_first", F.coalesce(before, F.lit(0)))
    cut = placed.select(F.col("conv_id").alias("page_id"), "turn", "role", "_first", F.posexplode("_lines").alias("within", "line"))
    return cut.select("page_id", "turn", "role", (F.col("_first") + F.col("within")).alias("line_no"), F.col("line").alias("text"), F.lit(0.95).alias("confidence"))


def with_boxes(lines: DataFrame) -> DataFrame:
    """lines with synthetic boxes l, t, r, b: every character 20 by 20, a line every 40, from (40, 100) on."""
    top = F.col("line_no") * LINE_PITCH + TOP
    return lines.withColumns({"l": F.lit(LEFT), "t": top, "r": LEFT + CHAR_SIZE * F.length("text"), "b": top + CHAR_SIZE})


def chat_pages(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated page fixtures: rec (chat, line, title, name, avatar), l, t, r, b, text."""
    raw = spark.read.csv(path, sep="\t", schema="rec string, l int, t int, r int, b int, text string", quote="")
    return raw.withColumn("page", F.col("_metadata.file_name"))


def samples(spark: SparkSession, path: str) -> DataFrame:
    """Annotated samples, one JSON object per file: one row per annotation (name, kind, l, t, r, b)."""
    box = "kind string, l double, t double, r double, b double"
    raw = spark.read.schema(f"name string, annotations array<struct<{box.replace(' ', ':').replace(',:', ',')}>>").json(path, multiLine=True)
    return raw.select("name", F.explode_outer("annotations").alias("a")).select("name", "a.*")


def images(spark: SparkSession, path: str) -> DataFrame:
    """(path, mime, bytes): image files as they are; the type follows the ending, JPEG if there is none."""
    ending = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    mime = F.when(ending == "png", "image/png").when(ending == "webp", "image/webp").otherwise("image/jpeg")
    return spark.read.format("binaryFile").load(path).select("path", mime.alias("mime"), F.col("content").alias("bytes"))


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """(word) in lower case, one per line, without blanks and comments; also without a trailing 's."""
    word = F.lower(F.trim("value"))
    raw = spark.read.text(path).select(word.alias("word")).where("word <> '' and not word like '#%'")
    return raw.union(raw.where("word like '%''s'").select(F.regexp_replace("word", "'s$", ""))).distinct()


def fingerprint(content: Column, tail: int = 65536) -> Column:
    """(length, SHA-256 of the last min(64 KB, length / 2) bytes) of binary content."""
    n = F.octet_length(content)
    size = F.least(F.lit(tail), F.floor(n / 2).cast("int"))
    return F.struct(n.alias("length"), F.sha2(F.substring(content, n - size + 1, size), 256).alias("sha256"))


def sample_size(width: Column, height: Column, photo_short: int = 2160, long_edge: int = 2048, most_pixels: int = 1080 * 8192) -> Column:
    """Power-of-two reduction for analysis: photos to a long edge of 2048, screenshots only beyond 1080 by 8192 pixels."""
    short, long = F.least(width, height), F.greatest(width, height)
    photo = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(long / long_edge, F.lit(1.0)))))
    screen = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.sqrt(width.cast("double") * height / most_pixels), F.lit(1.0)))))
    return F.when(short >= photo_short, photo).otherwise(screen).cast("int")


def upright(x: Column, y: Column, width: Column, height: Column, orientation: Column) -> Column:
    """Raw coordinates under one of the eight EXIF orientations as upright ones: struct(x, y)."""
    cases = {2: (width - x, y), 3: (width - x, height - y), 4: (x, height - y), 5: (y, x), 6: (height - y, x), 7: (height - y, width - x), 8: (y, width - x)}
    out_x, out_y = x, y
    for k, (a, b) in cases.items():
        out_x, out_y = F.when(orientation == k, a).otherwise(out_x), F.when(orientation == k, b).otherwise(out_y)
    return F.struct(out_x.alias("x"), out_y.alias("y"))


def overrides(text: Column) -> Column:
    """'id:STATE;id:STATE' as a map; unknown states and broken entries go, the old name tracking means longnum."""
    pairs = F.filter(F.split(F.coalesce(text, F.lit("")), ";"), lambda x: x.rlike("^[^:]+:(ON|OFF)$"))
    entry = lambda x: F.struct(F.regexp_replace(F.substring_index(x, ":", 1), "^tracking$", "longnum").alias("key"), F.substring_index(x, ":", -1).alias("value"))
    # Of entries for one id the last counts.
    named = F.transform(pairs, entry)
    last = F.filter(named, lambda x, i: ~F.exists(F.slice(named, i + 2, F.size(named)), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(last)


def overrides_text(states: Column) -> Column:
    """The map of overrides() as text, in the order of ids."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(states)), lambda x: F.concat_ws(":", x["key"], x["value"])), ";")


def write_redacted(df: DataFrame, path: str, mode: str = "append") -> None:
    """Redacted rows as a new table beside the original."""
    df.write.mode(mode).parquet(path)


def table_fingerprint(df: DataFrame) -> tuple[int, int]:
    """(rows, a sum of row hashes) of a table, whatever the order and partitioning of its rows."""
    wide = F.xxhash64(*[F.to_json(F.col(c)) if isinstance(t.dataType, MapType) else F.col(c) for c, t in zip(df.columns, df.schema)])
    row = df.agg(F.count("*").alias("n"), F.sum(wide.cast("decimal(38,0)")).alias("h")).first()
    return row.n, int(row.h or 0)


def write_if_unchanged(df: DataFrame, path: str, seen: tuple[int, int]) -> bool:
    """Replaces a table only if its fingerprint is still the one that was seen. The new table is written beside it and moved in
    its place; the old one is deleted once the new one has been read back with the rows that were written, else put back."""
    spark = df.sparkSession
    if table_fingerprint(spark.read.parquet(path)) != tuple(seen):
        return False
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at, new, old = (jvm.org.apache.hadoop.fs.Path(path + x) for x in ("", ".new", ".old"))
    store = at.getFileSystem(conf)
    df.write.mode("overwrite").parquet(f"{path}.new")
    written = table_fingerprint(spark.read.parquet(f"{path}.new"))
    store.rename(at, old)
    if store.rename(new, at) and table_fingerprint(spark.read.parquet(path)) == written:
        store.delete(old, True)
        return True
    store.delete(at, True)
    store.rename(old, at)
    return False
