"""Gene annotation, GTF or GFF3, as one row for each exon of each transcript."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isoframe.functions.intervals import chromosome, is_valid, strand
from isoframe.sources.files import lines
from isoframe.sources.sniff import sniff


def _rows(found: DataFrame) -> DataFrame:
    c = F.split("value", "\t")
    rows = found.where(F.size(c) >= 9)
    return rows.select(
        chromosome(F.get(c, 0)).alias("chromosome"), F.lower(F.get(c, 2)).alias("feature"), F.get(c, 3).try_cast("int").alias("start"),
        F.get(c, 4).try_cast("int").alias("end"), strand(F.get(c, 6)).alias("strand"), F.get(c, 8).alias("attributes"),
    ).where(is_valid(F.col("start"), F.col("end")))


def gtf_attribute(attributes: Column, key: str) -> Column:
    """The quoted value of a key, null where it is missing."""
    return F.nullif(F.regexp_extract(attributes, rf'(?:^|[;\s]){key} +"([^"]*)"', 1), F.lit(""))


def gff_attributes(attributes: Column) -> Column:
    """key -> value, a value ``type:id`` being its id; of a repeated key the first."""
    pairs = F.filter(F.transform(F.split(attributes, ";"), lambda x: F.split(F.trim(x), "=", 2)), lambda p: F.size(p) == 2)
    entries = F.transform(pairs, lambda p: F.struct(F.get(p, 0).alias("k"), F.regexp_replace(F.get(p, 1), r"^(gene|transcript|mRNA|exon|CDS|rna):", "").alias("v")))
    first = F.filter(entries, lambda e, i: F.array_position(F.transform(entries, lambda y: y["k"]), e["k"]) == i + 1)
    return F.map_from_entries(first)


def _name_exons(df: DataFrame) -> DataFrame:
    """Exons without an id are numbered within their transcript."""
    nth = F.row_number().over(Window.partitionBy("transcript").orderBy("start", "end"))
    out = df.withColumn("exon_id", F.coalesce("exon_id", F.concat_ws(".", "transcript", nth.cast("string"))))
    return out.select("transcript", "gene", "chromosome", "start", "end", "strand", "exon_id")


def gtf_exons(found: DataFrame) -> DataFrame:
    rows = _rows(found).where("feature = 'exon'")
    get = lambda k: gtf_attribute(F.col("attributes"), k)
    place = F.concat(F.col("chromosome"), F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"), F.col("strand"))
    transcript = F.coalesce(get("transcript_id"), place)
    return _name_exons(rows.select(transcript.alias("transcript"), F.coalesce(get("gene_id"), transcript).alias("gene"), "chromosome", "start", "end", "strand", get("exon_id").alias("exon_id")).distinct())


def gff_exons(found: DataFrame) -> DataFrame:
    """Exons name their transcripts as parents, transcripts their gene; lines may come in any order."""
    rows = _rows(found).withColumn("a", gff_attributes(F.col("attributes")))
    a = lambda k: F.col("a")[k]
    transcripts = rows.where("feature RLIKE 'rna|transcript' AND NOT feature RLIKE 'gene'").select(F.coalesce(a("ID"), a("transcript_id")).alias("transcript"), F.coalesce(a("Parent"), a("gene_id"), a("GeneID")).alias("gene_of")).where("transcript IS NOT NULL").dropDuplicates(["transcript"])
    exons = rows.where("feature = 'exon'").select("*", F.explode(F.split(F.coalesce(a("Parent"), a("transcript_id")), ",")).alias("parent"))
    exons = exons.select(F.regexp_replace("parent", r"^(transcript|mRNA|rna):", "").alias("transcript"), a("gene_id").alias("own_gene"), "chromosome", "start", "end", "strand", F.coalesce(a("exon_id"), a("ID")).alias("exon_id"))
    joined = exons.join(transcripts, "transcript", "left")
    return _name_exons(joined.select("transcript", F.coalesce("gene_of", "own_gene", "transcript").alias("gene"), "chromosome", "start", "end", "strand", "exon_id").distinct())


def read_annotation(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """(transcript, gene, chromosome, start, end, strand, exon_id) of a GTF or GFF3 file."""
    kind = kind or sniff(spark, path)
    if kind not in ("gtf", "gff"):
        raise ValueError(f"{path} is neither GTF nor GFF3")
    return (gtf_exons if kind == "gtf" else gff_exons)(lines(spark, path))


def exon_sets(transcript_exons: DataFrame) -> DataFrame:
    """One row for each exon with the sets of its genes and transcripts."""
    sets = [F.sort_array(F.collect_set(c)).alias(f"{c}s") for c in ("gene", "transcript")]
    return transcript_exons.groupBy("chromosome", "start", "end", "strand", "exon_id").agg(*sets)
