"""Format of an input file, from its first bytes or its first line that is not a comment."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: Formats as published by the tools that write them; tried in this order.
LINE_FORMATS = {
    "sam": r"^(@(HD|SQ|RG|PG|CO)\t.*|[^\t]+\t\d+\t[^\t]+\t\d+\t\d+\t(\*|([0-9]+[MIDNSHPX=])+)\t.*)$",
    "star": r"^\S+\s+\d+\s+\d+\s+[0-2]\s+\d+\s+[01]\s+\d+\s+\d+\s+\d+\s*$",
    "sj": r"^[\w.]+:\d+-\d+[+.-]?\t\d+(\t.*)?$",
    "gff": r"^([^\t]+\t){8}\s*[\w.]+=[^;]*(;.*)?$",
    "gtf": r'^([^\t]+\t){8}\s*[\w.]+ +"[^"]*";.*$',
    "gmap": r"^\s+[+-][\w.]+:\d+-\d+\s+\(\d+-\d+\)\s+\d+%.*$",
    "gmap_extract": r"^[\w.]+\t\d+\t\d+\t[+.-]\t[\d,]*$",
}


def is_bam(spark: SparkSession, path: str) -> bool:
    """Whether the file starts as a BGZF block does."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.isFile(hadoop):
        return False
    stream = fs.open(hadoop)
    try:
        return [stream.read() for _ in range(4)] == [0x1F, 0x8B, 8, 4]
    finally:
        stream.close()


def sniff(spark: SparkSession, path: str) -> str:
    """bam, or a name of LINE_FORMATS, or unknown. Of alignment text, which has other lines too, any line decides."""
    if is_bam(spark, path):
        return "bam"
    text = spark.read.text(path)
    first = text.where("value <> '' AND NOT startswith(value, '#')").limit(1)
    tests = [F.col("value").rlike(p).alias(name) for name, p in LINE_FORMATS.items()]
    found = first.select(*tests).head()
    if found is not None:
        for name in LINE_FORMATS:
            if found[name]:
                return name
    return "gmap" if not text.where(F.col("value").rlike(LINE_FORMATS["gmap"])).isEmpty() else "unknown"
