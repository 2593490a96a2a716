"""Registered queries of the interval and splicing engine, each with the SQL it is held against.

All run over whole tables, on the interval frames of ``plans.views``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoframe.functions import cigar as cg
from isoframe.functions import intervals as iv
from isoframe.functions import text as tx
from isoframe.operators import annotate, coupling, events, isoforms, junctions, psi, report, retention, terminal
from isoframe.operators.interval_join import interval_join
from isoframe.plans import views
from isoframe.schemas import GRAPH
from isoframe.scratch import new_path, written
from isoframe.sources import alignments, annotation, junction_files

BIN = 256
SAMPLES = ["A", "N", "R"]
EVENTS = ["sample", "event", "chromosome", "start", "end", "strand"]
_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}

JUNCTIONS = """junctions AS (SELECT {sample} AS sample, CAST(1 + l_suppkey % 5 AS VARCHAR) AS chromosome, CASE l_linestatus WHEN 'O' THEN '+' ELSE '-' END AS strand,
  CAST(l_partkey * 40 + 100 AS INT) AS "start", CAST((l_partkey + 1 + CAST(l_quantity AS INT) % 6) * 40 + 90 - 5 * (l_linenumber % 2) AS INT) AS "end", count(*) AS "count" FROM lineitem GROUP BY 1, 2, 3, 4, 5)"""
ALL, BY_SAMPLE = JUNCTIONS.format(sample="'all'"), JUNCTIONS.format(sample="l_returnflag")
PSI = """p AS (SELECT *, CAST("count" AS DOUBLE) / sum("count") OVER s AS psi_start, count(*) OVER s AS n_start, max("end") OVER s AS max_end,
  CAST("count" AS DOUBLE) / sum("count") OVER e AS psi_end, count(*) OVER e AS n_end FROM junctions
  WINDOW s AS (PARTITION BY sample, chromosome, strand, "start"), e AS (PARTITION BY sample, chromosome, strand, "end"))"""
SAME = "a.sample = b.sample AND a.chromosome = b.chromosome AND a.strand = b.strand"
SE = f"""se AS (SELECT l.sample, 'SE' AS event, l.chromosome, a."end" AS "start", b."start" AS "end", l.strand, [l."start", a."end", b."start", l."end"] AS sites, (a.psi_start + b.psi_end) / 2 AS psi
  FROM p l JOIN p a ON l.sample = a.sample AND l.chromosome = a.chromosome AND l.strand = a.strand AND l."start" = a."start" AND a."end" < l."end"
  JOIN p b ON l."end" = b."end" AND {SAME} WHERE b."start" - a."end" > 3)"""
ALT = f"""alt AS (SELECT a.sample, CASE a.strand WHEN '-' THEN 'A5' ELSE 'A3' END AS event, a.chromosome, a."end" AS "start", b."end" AS "end", a.strand, [a."start", a."start", a."end", b."end"] AS sites, a.psi_start AS psi
    FROM p a JOIN p b ON {SAME} AND a."start" = b."start" WHERE b."end" - a."end" >= 3),
  alt2 AS (SELECT a.sample, CASE a.strand WHEN '-' THEN 'A3' ELSE 'A5' END AS event, a.chromosome, a."start" AS "start", b."start" AS "end", a.strand, [a."start", b."start", a."end", a."end"] AS sites, b.psi_end AS psi
    FROM p a JOIN p b ON {SAME} AND a."end" = b."end" WHERE b."start" - a."start" > 3)"""
MXE = f"""ord AS (SELECT *, lead(site) OVER (PARTITION BY sample, chromosome, strand ORDER BY site) AS nxt FROM (SELECT DISTINCT sample, chromosome, strand, "start" AS site FROM junctions UNION SELECT DISTINCT sample, chromosome, strand, "end" FROM junctions)),
  sp AS (SELECT a.sample, a.chromosome, a.strand, a."start" AS S, a."end" AS e1, b."end" AS e2, a.max_end, b.psi_start AS pa, max(CASE WHEN b."end" - a."end" >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY a.sample, a.chromosome, a.strand, a."start") AS live FROM p a JOIN p b ON {SAME} AND a."start" = b."start" AND a."end" < b."end"),
  ep AS (SELECT a.sample, a.chromosome, a.strand, a."end" AS E, a."start" AS s1, b."start" AS s2, b.psi_end AS pb, max(CASE WHEN b."start" - a."start" > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY a.sample, a.chromosome, a.strand, a."end") AS live FROM p a JOIN p b ON {SAME} AND a."end" = b."end" AND a."start" < b."start"),
  mxe AS (SELECT a.sample, 'MXE' AS event, a.chromosome, a.S AS "start", b.E AS "end", a.strand, [a.S, a.e1, b.s1, a.e2, b.s2, b.E] AS sites, (a.pa + b.pb) / 2 AS psi
    FROM sp a JOIN ord o ON a.sample = o.sample AND a.chromosome = o.chromosome AND a.strand = o.strand AND o.nxt = a.e2 JOIN ep b ON {SAME} AND b.s1 = o.site
    WHERE a.live = 1 AND b.live = 1 AND a.e1 <= b.s1 AND a.e2 <= b.s2 AND b.E > a.max_end)"""
EXONS = """exons AS (SELECT chromosome, strand, CAST(p_partkey * 40 + 91 AS INT) AS "start", CAST(p_partkey * 40 + 99 AS INT) AS "end", 'E' || p_partkey AS exon_id, p_brand AS gene, p_brand || '.' || (p_size % 3) AS transcript
  FROM part, (VALUES ('1'), ('2'), ('3'), ('4'), ('5')) c(chromosome), (VALUES ('+'), ('-')) s(strand))"""
READS = """rb AS (SELECT l_orderkey AS k, list(DISTINCT l_partkey ORDER BY l_partkey) AS parts FROM lineitem GROUP BY 1),
  reads AS (SELECT o_orderstatus AS sample, 'r' || k AS name, CAST(1 + o_custkey % 5 AS VARCHAR) AS chromosome, CASE WHEN o_custkey % 2 = 0 THEN '+' ELSE '-' END AS strand,
    CAST(parts[1] * 40 + 91 AS INT) AS "start", CAST(parts[-1] * 40 + 99 AS INT) AS "end", parts, len(parts) AS n FROM orders JOIN rb ON o_orderkey = k)"""
OUT = 'sample, event, chromosome, "start", "end", strand, array_to_string(sites, \'-\') AS sites, round(psi, 6) AS psi'


def register(name: str, sql: str | None = None):
    def add(f):
        _queries[name] = f
        if sql:
            _sql[name] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def shown(df: DataFrame, *more: str) -> DataFrame:
    return df.select(*EVENTS, F.array_join("sites", "-").alias("sites"), F.round("psi", 6).alias("psi"), *more)


def with_psi(spark: SparkSession, sf: str) -> DataFrame:
    # every kind of event reads them several times
    return psi.with_psi(written(views.junctions(spark, sf), "junctions"))


@register("junction_count", f"""WITH {ALL} SELECT chromosome, "start", "end", strand, "count" FROM junctions""")
def _(spark, sf):
    return views.junctions(spark, sf).select("chromosome", "start", "end", "strand", "count")


@register("junction_from_reads", f"""WITH {READS}, i AS (SELECT sample, chromosome, strand, parts, unnest(range(1, n)) AS x FROM reads WHERE n > 1)
SELECT sample, chromosome, CAST(parts[x] * 40 + 100 AS INT) AS "start", CAST(parts[x + 1] * 40 + 90 AS INT) AS "end", strand, count(*) AS "count" FROM i GROUP BY ALL""")
def _(spark, sf):
    return junctions.count_junctions(views.reads(spark, sf))


@register("junction_min_count", f"""WITH {ALL} SELECT chromosome, "start", "end", strand, "count" FROM junctions WHERE "count" >= 3""")
def _(spark, sf):
    return junctions.at_least(views.junctions(spark, sf), 3).select("chromosome", "start", "end", "strand", "count")


@register("junction_overall_filter", f"""WITH {BY_SAMPLE} SELECT * FROM junctions j WHERE (SELECT sum("count") FROM junctions k WHERE k.chromosome = j.chromosome AND k."start" = j."start" AND k."end" = j."end" AND k.strand = j.strand) >= 2""")
def _(spark, sf):
    return junctions.drop_low_overall(views.junctions(spark, sf, True), 2)


@register("junction_summary", f"""WITH {ALL} SELECT 'before' AS stage, count(*) AS n FROM junctions UNION ALL SELECT 'after', count(*) FROM junctions WHERE "count" >= 3""")
def _(spark, sf):
    j = views.junctions(spark, sf)
    return junctions.summary(j, junctions.at_least(j, 3))


@register("junction_merge", f"""WITH {BY_SAMPLE} SELECT chromosome, "start", "end", strand, CAST(sum("count") AS BIGINT) AS "count" FROM junctions GROUP BY ALL""")
def _(spark, sf):
    j = views.junctions(spark, sf, True)
    return junctions.merge(*[j.where(F.col("sample") == s).withColumn("sample", F.lit("all")) for s in SAMPLES]).drop("sample")


@register("junction_range", f"""WITH {ALL} SELECT * FROM junctions WHERE "start" BETWEEN 1000 AND 20000""")
def _(spark, sf):
    return junctions.starts_between(views.junctions(spark, sf), 1000, 20000)


@register("junction_lines", f"""WITH {ALL} SELECT chromosome || ':' || "start" || '-' || "end" || strand || chr(9) || "count" AS line FROM junctions""")
def _(spark, sf):
    return views.junctions(spark, sf).select(tx.junction_line().alias("line"))


@register("count_matrix", f"""WITH {BY_SAMPLE} SELECT chromosome || ':' || "start" || '-' || "end" || strand AS junction, {", ".join(f"CAST(sum(\"count\") FILTER (sample = '{s}') AS BIGINT) AS {s}" for s in SAMPLES)} FROM junctions GROUP BY 1""")
def _(spark, sf):
    return junctions.count_matrix(views.junctions(spark, sf, True), SAMPLES)


def _psi_sql(side: str) -> str:
    cells = ", ".join(f"round(max(psi_{side}) FILTER (sample = '{s}'), 6) AS {s}" for s in SAMPLES)
    return f"""WITH {BY_SAMPLE}, {PSI} SELECT chromosome || ':' || "start" || '-' || "end" || strand AS junction, {cells} FROM p GROUP BY 1"""


def _psi_query(side: str):
    return lambda spark, sf: psi.psi_matrix(views.junctions(spark, sf, True), side, SAMPLES).select("junction", *[F.round(s, 6).alias(s) for s in SAMPLES])


for _side in ("start", "end"):
    register(f"psi_same_{_side}", _psi_sql(_side))(_psi_query(_side))


@register("event_se", f"WITH {ALL}, {PSI}, {SE} SELECT {OUT} FROM se")
def _(spark, sf):
    return shown(events.skipped_exons(with_psi(spark, sf)))


@register("event_alt_same_start", f"WITH {ALL}, {PSI}, {ALT} SELECT {OUT} FROM alt")
def _(spark, sf):
    return shown(events.alternative_ends(with_psi(spark, sf)))


@register("event_alt_same_end", f"WITH {ALL}, {PSI}, {ALT} SELECT {OUT} FROM alt2")
def _(spark, sf):
    return shown(events.alternative_starts(with_psi(spark, sf)))


@register("event_mxe", f"WITH {ALL}, {PSI}, {MXE} SELECT {OUT} FROM mxe")
def _(spark, sf):
    return shown(events.mutually_exclusive(with_psi(spark, sf)))


@register("event_union", f"WITH {BY_SAMPLE}, {PSI}, {SE}, {ALT}, {MXE} SELECT {OUT} FROM (SELECT * FROM se UNION ALL SELECT * FROM alt UNION ALL SELECT * FROM alt2 UNION ALL SELECT * FROM mxe)")
def _(spark, sf):
    return shown(events.all_events(views.junctions(spark, sf, True)))


@register("event_strings", f"""WITH {ALL}, {PSI}, {SE} SELECT chromosome || ':' || sites[1] || '-' || sites[4] || strand || chr(9) || 'SE' || chr(9) || 'NA' || chr(9) || chromosome || ':' || array_to_string(sites, '-') AS line FROM se""")
def _(spark, sf):
    return events.skipped_exons(with_psi(spark, sf)).select(tx.event_line(F.lit(None).cast("string")).alias("line"))


@register("site_adjacency", f"WITH {ALL}, {PSI}, {MXE} SELECT sample, chromosome, strand, site, nxt AS next_site FROM ord")
def _(spark, sf):
    return events.site_order(views.junctions(spark, sf))


@register("extreme_site", f"""WITH {ALL} SELECT sample, chromosome, strand, "start" AS node, max("end") AS site, 'start' AS side FROM junctions GROUP BY ALL UNION ALL SELECT sample, chromosome, strand, "end", min("start"), 'end' FROM junctions GROUP BY ALL""")
def _(spark, sf):
    j = views.junctions(spark, sf)
    parts = [psi.farthest_site(j, s).withColumn("side", F.lit(s)) for s in ("start", "end")]
    return parts[0].unionByName(parts[1])


@register("kth_site", f"""WITH {ALL} SELECT sample, chromosome, strand, "start", "end", "count" FROM (SELECT *, row_number() OVER (PARTITION BY sample, chromosome, strand, "start" ORDER BY "end") AS k FROM junctions) WHERE k = 2""")
def _(spark, sf):
    return psi.kth_site(views.junctions(spark, sf), 2)


@register("site_neighbours", f"""WITH {ALL} SELECT sample, chromosome, strand, "start" AS node, string_agg("end", '-' ORDER BY "end") AS sites FROM junctions GROUP BY 1, 2, 3, 4""")
def _(spark, sf):
    return psi.neighbours(views.junctions(spark, sf)).withColumn("sites", F.array_join("sites", "-"))


@register("interval_overlap_join", f"""WITH {ALL}, {EXONS} SELECT j.chromosome, j.strand, j."start", j."end", e.exon_id FROM junctions j JOIN exons e ON j.chromosome = e.chromosome AND j.strand = e.strand AND j."start" <= e."end" AND j."end" >= e."start" """)
def _(spark, sf):
    right = views.exons(spark, sf).select("chromosome", "strand", F.col("start").alias("r_start"), F.col("end").alias("r_end"), "exon_id")
    return interval_join(views.junctions(spark, sf), right, ["chromosome", "strand"], BIN).select("chromosome", "strand", "start", "end", "exon_id")


@register("interval_anti_join", f"""WITH {ALL}, {EXONS} SELECT j.chromosome, j.strand, j."start", j."end" FROM junctions j WHERE NOT EXISTS (SELECT 1 FROM exons e WHERE j.chromosome = e.chromosome AND j.strand = e.strand AND j."start" <= e."end" AND j."end" >= e."start")""")
def _(spark, sf):
    key = ["chromosome", "strand", "start", "end"]
    right = views.exons(spark, sf).select("chromosome", "strand", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    j = views.junctions(spark, sf).select(*key)
    return j.join(interval_join(j, right, key[:2], BIN).select(*key).distinct(), key, "left_anti")


def _percent(mode: str) -> str:
    of = {"self": 'j."end" - j."start"', "hull": 'greatest(j."end", e."end") - least(j."start", e."start")', "narrow": 'least(j."end" - j."start", e."end" - e."start")'}[mode]
    return f'round((least(j."end", e."end") - greatest(j."start", e."start")) * 100.0 / ({of}), 6) AS {mode}'


@register("overlap_percent", f"""WITH {ALL}, {EXONS} SELECT j.chromosome, j.strand, j."start", j."end", e.exon_id, {", ".join(map(_percent, ("self", "hull", "narrow")))} FROM junctions j JOIN exons e ON j.chromosome = e.chromosome AND j.strand = e.strand AND j."start" <= e."end" AND j."end" >= e."start" """)
def _(spark, sf):
    right = views.exons(spark, sf).select("chromosome", "strand", F.col("start").alias("r_start"), F.col("end").alias("r_end"), "exon_id")
    pairs = interval_join(views.junctions(spark, sf), right, ["chromosome", "strand"], BIN)
    ratios = [F.round(iv.overlap_percent(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end"), m), 6).alias(m) for m in ("self", "hull", "narrow")]
    return pairs.select("chromosome", "strand", "start", "end", "exon_id", *ratios)


@register("interval_order", f"""WITH {ALL}, a AS (SELECT *, lead("start") OVER w AS s2, lead("end") OVER w AS e2 FROM junctions WINDOW w AS (PARTITION BY chromosome, strand ORDER BY "start", "end"))
SELECT chromosome, strand, "start", "end", s2 - "end" >= 3 AS up, "start" - e2 >= 3 AS down, CASE WHEN abs("start" - s2) < 3 THEN CASE WHEN abs("end" - e2) < 3 THEN 0 WHEN "end" < e2 THEN -1 ELSE 1 END WHEN "start" < s2 THEN -1 ELSE 1 END AS tolerant FROM a WHERE s2 IS NOT NULL""")
def _(spark, sf):
    from isoframe.operators.ordered import with_next

    j = views.junctions(spark, sf).withColumn("both", F.struct("start", "end"))
    a = with_next(j, ["chromosome", "strand"], ["start", "end"], "both", "nxt").where("nxt IS NOT NULL")
    s, e, s2, e2 = F.col("start"), F.col("end"), F.col("nxt.start"), F.col("nxt.end")
    return a.select("chromosome", "strand", "start", "end", iv.is_upstream(e, s2, 3).alias("up"), iv.is_downstream(s, e2, 3).alias("down"), iv.tolerant_order(s, e, s2, e2, 3).alias("tolerant"))


ANNOTATED = "coalesce(f.subtype, 'NA') AS subtype, coalesce(f.is_novel, true) AS is_novel, coalesce(f.exons, 'NA') AS exons, coalesce(f.genes, 'NA') AS genes, coalesce(f.transcripts, 'NA') AS transcripts"
SETS = "string_agg(DISTINCT exon_id, ',' ORDER BY exon_id) AS exons, string_agg(DISTINCT gene, ',' ORDER BY gene) AS genes, string_agg(DISTINCT transcript, ',' ORDER BY transcript) AS transcripts"


def annotated(df: DataFrame) -> DataFrame:
    sets = [F.when(F.size(c) > 0, F.array_join(c, ",")).otherwise("NA").alias(c) for c in ("exons", "genes", "transcripts")]
    return df.select(*EVENTS, F.array_join("sites", "-").alias("sites"), F.round("psi", 6).alias("psi"), "subtype", "is_novel", *sets)


def _annotated_sql(source: str, test: str, found: str) -> str:
    return f"""WITH {ALL}, {PSI}, {SE}, {ALT}, {MXE}, {EXONS}, ev AS ({source}),
m AS (SELECT ev.*, e."start" AS xs, e."end" AS xe, e.exon_id, e.gene, e.transcript FROM ev JOIN exons e ON ev.chromosome = e.chromosome AND ev.strand = e.strand AND {test}),
{found} SELECT ev.sample, ev.event, ev.chromosome, ev."start", ev."end", ev.strand, array_to_string(ev.sites, '-') AS sites, round(ev.psi, 6) AS psi, {ANNOTATED} FROM ev LEFT JOIN f ON ev.sample = f.sample AND ev.event = f.event AND ev.chromosome = f.chromosome AND ev.strand = f.strand AND ev.sites = f.sites AND ev."start" = f."start" AND ev."end" = f."end" """


GROUPED = 'sample, event, chromosome, "start", "end", strand, sites'


@register("se_subtype", _annotated_sql("SELECT * FROM se", 'ev."start" <= e."start" AND ev."end" >= e."end"', f"""k AS (SELECT *, CASE WHEN abs("start" - xs) <= 1 AND abs("end" - xe) <= 1 THEN 'exact' WHEN abs("start" - xs) <= 1 OR abs("end" - xe) <= 1 THEN 'part' ELSE 'other' END AS kind FROM m),
f AS (SELECT {GROUPED}, CASE WHEN count(DISTINCT kind || '|' || transcript) = 1 THEN min(kind) WHEN count(DISTINCT transcript) = 1 THEN 'single' ELSE 'multi' END AS subtype, false AS is_novel, {SETS} FROM k GROUP BY {GROUPED})"""))
def _(spark, sf):
    return annotated(annotate.annotate_skipped(events.skipped_exons(with_psi(spark, sf)), views.exons(spark, sf), BIN))


@register("alt_annotation", _annotated_sql("SELECT * FROM alt UNION ALL SELECT * FROM alt2", """CASE WHEN ev.sites[1] = ev.sites[2] THEN abs(ev.sites[3] - e."start") <= 3 OR abs(ev.sites[4] - e."start") <= 3 ELSE abs(ev.sites[1] - e."end") <= 3 OR abs(ev.sites[2] - e."end") <= 3 END""", f"f AS (SELECT {GROUPED}, 'NA' AS subtype, false AS is_novel, {SETS} FROM m GROUP BY {GROUPED})"))
def _(spark, sf):
    j = with_psi(spark, sf)
    return annotated(annotate.annotate_alternative(events.alternative_ends(j).unionByName(events.alternative_starts(j)), views.exons(spark, sf), BIN))


@register("mxe_annotation", _annotated_sql("SELECT * FROM mxe", '((ev.sites[2] <= e."start" AND ev.sites[3] >= e."end") OR (ev.sites[4] <= e."start" AND ev.sites[5] >= e."end"))', f"""k AS (SELECT *, sites[2] <= xs AND sites[3] >= xe AS in1, sites[4] <= xs AND sites[5] >= xe AS in2 FROM m),
g AS (SELECT {GROUPED}, gene FROM k GROUP BY {GROUPED}, gene HAVING bool_or(in1) AND bool_or(in2)),
g1 AS (SELECT {GROUPED}, min(gene) AS best FROM g GROUP BY {GROUPED}),
h AS (SELECT k.*, g1.best, bool_or(in1) OVER (PARTITION BY {", ".join("k." + c.strip() for c in GROUPED.split(","))}) AS any1 FROM k LEFT JOIN g1 USING ({GROUPED})),
f AS (SELECT {GROUPED}, 'NA' AS subtype, min(best) IS NULL AS is_novel, {SETS} FROM h WHERE CASE WHEN best IS NOT NULL THEN gene = best WHEN any1 THEN in1 ELSE true END GROUP BY {GROUPED})"""))
def _(spark, sf):
    return annotated(annotate.annotate_exclusive(events.mutually_exclusive(with_psi(spark, sf)), views.exons(spark, sf), BIN))


@register("exon_ordinal", f"""WITH {EXONS} SELECT transcript || '|' || chromosome || '|' || strand AS transcript, exon_id, row_number() OVER w - 1 AS forward, -row_number() OVER v AS backward, CASE strand WHEN '-' THEN row_number() OVER v ELSE row_number() OVER w END AS ordinal FROM exons
WINDOW w AS (PARTITION BY transcript, chromosome, strand ORDER BY "start", "end", exon_id), v AS (PARTITION BY transcript, chromosome, strand ORDER BY "start" DESC, "end" DESC, exon_id DESC)""")
def _(spark, sf):
    return terminal.exon_ordinals(views.transcript_exons(spark, sf)).select("transcript", "exon_id", *[F.col(c).cast("long").alias(c) for c in ("forward", "backward", "ordinal")])


@register("terminal_exon_subtype", f"""WITH {ALL}, {PSI}, {ALT}, {EXONS}, te AS (SELECT chromosome, strand, "start", "end", (p // 4) || '.' || t AS transcript FROM (SELECT *, CAST(substr(exon_id, 2) AS BIGINT) AS p FROM exons) x, (VALUES (2), (3)) v(t) WHERE p % 4 < 2 OR p % 4 = t),
r AS (SELECT *, row_number() OVER (PARTITION BY chromosome, strand, transcript ORDER BY CASE strand WHEN '-' THEN -"start" ELSE "start" END) AS n, arg_min("end", "start") OVER z AS first_end, arg_max("start", "start") OVER z AS last_start FROM te WINDOW z AS (PARTITION BY chromosome, strand, transcript)),
x AS (SELECT DISTINCT chromosome, strand, "start", "end" FROM r WHERE n = 2),
y AS (SELECT chromosome, strand, "start", "end", list(first_end) AS fe, list(last_start) AS ls FROM r SEMI JOIN x USING (chromosome, strand, "start", "end") GROUP BY ALL),
ev AS (SELECT * FROM alt UNION ALL SELECT * FROM alt2)
SELECT DISTINCT ev.sample, ev.event, ev.chromosome, ev."start", ev."end", ev.strand, array_to_string(ev.sites, '-') AS sites,
  CASE WHEN (ev.sites[1] = ev.sites[2]) = (ev.strand = '-') THEN 'AFE' ELSE 'ALE' END AS terminal
FROM ev JOIN y ON ev.chromosome = y.chromosome AND ev.strand = y.strand AND len(y.fe) >= 2 AND CASE WHEN ev.sites[1] = ev.sites[2]
  THEN abs(ev.sites[1] - y."end") <= 3 AND len(list_filter(y.ls, lambda z: abs(z - ev.sites[3]) <= 3)) > 0 AND len(list_filter(y.ls, lambda z: abs(z - ev.sites[4]) <= 3)) > 0
  ELSE abs(ev.sites[4] - y."start") <= 3 AND len(list_filter(y.fe, lambda z: abs(z - ev.sites[1]) <= 3)) > 0 AND len(list_filter(y.fe, lambda z: abs(z - ev.sites[2]) <= 3)) > 0 END""")
def _(spark, sf):
    # two transcripts for every four parts: they share the first two exons and differ in the last
    p = F.regexp_extract("exon_id", r"(\d+)", 1).cast("long")
    rows = views.transcript_exons(spark, sf).withColumn("p", p).withColumn("t", F.explode(F.array(F.lit(2), F.lit(3)))).where("p % 4 < 2 OR p % 4 = t")
    rows = rows.withColumn("transcript", F.concat_ws("|", F.floor(F.col("p") / 4), "t", "chromosome", "strand"))
    j = with_psi(spark, sf)
    alt = events.alternative_ends(j).unionByName(events.alternative_starts(j))
    return terminal.terminal_subtypes(alt, rows, BIN).select(*EVENTS, F.array_join("sites", "-").alias("sites"), "terminal")


GAPS = """ev AS (SELECT DISTINCT sample, chromosome, strand, "start", "end" FROM se),
eg AS (SELECT DISTINCT sample, chromosome, strand, "end" AS gs, nx AS ge FROM (SELECT *, lead("start") OVER (PARTITION BY sample, chromosome, strand ORDER BY "start", "end") AS nx FROM ev) WHERE nx >= "end"),
xg AS (SELECT chromosome, strand, "end" AS xs, nx AS xe, exon_id, gene, transcript || '|' || chromosome || '|' || strand AS transcript FROM (SELECT *, lead("start") OVER (PARTITION BY transcript, chromosome, strand ORDER BY "start", "end", exon_id) AS nx FROM exons) WHERE nx >= "end"),
ir AS (SELECT DISTINCT e.sample, e.chromosome, e.strand, least(gs, xs) AS "start", greatest(ge, xe) AS "end", list_sort([gs, xs, ge, xe]) AS sites, xs + 1 AS intron_start, xe - 1 AS intron_end, transcript, exon_id
  FROM eg e JOIN xg x ON e.chromosome = x.chromosome AND e.strand = x.strand AND gs <= xe AND ge >= xs WHERE (least(ge, xe) - greatest(gs, xs)) * 100.0 / (greatest(ge, xe) - least(gs, xs)) > 50)"""
#: In the test tables gaps of events and of exons never come closer than this.
IR_PERCENT = 50.0


@register("gap_ir", f"""WITH {ALL}, {PSI}, {SE}, {EXONS}, {GAPS} SELECT sample, chromosome, strand, "start", "end", array_to_string(sites, '-') AS sites, intron_start, intron_end, transcript, exon_id FROM ir""")
def _(spark, sf):
    found = retention.retained_introns(events.skipped_exons(with_psi(spark, sf)), views.transcript_exons(spark, sf), IR_PERCENT)
    return found.select(*GRAPH, "start", "end", F.array_join("sites", "-").alias("sites"), "intron_start", "intron_end", "transcript", "exon_id")


BLOCKS = """blocks AS (SELECT CAST(1 + l_suppkey % 5 AS VARCHAR) AS chromosome, CAST(l_partkey * 40 AS INT) AS s, CAST(l_partkey * 40 + l_quantity AS INT) AS e FROM lineitem)"""
#: Depth by position, then its running sums, so that a region takes two look-ups and not a row for each of its positions.
DEPTH = """cov AS (SELECT chromosome, x, count(*) AS n FROM (SELECT chromosome, unnest(range(s, e + 1)) AS x FROM blocks) GROUP BY ALL),
cum AS (SELECT chromosome, x, sum(n) OVER w AS total, count(*) OVER w AS covered FROM cov WINDOW w AS (PARTITION BY chromosome ORDER BY x)),
cut AS (SELECT r.region, r.side, c.total, c.covered FROM rg r ASOF JOIN cum c ON r.chromosome = c.chromosome AND r.e >= c.x
  UNION ALL SELECT r.region, r.side, -c.total, -c.covered FROM rg r ASOF JOIN cum c ON r.chromosome = c.chromosome AND r.s > c.x),
dep AS (SELECT region, side, CAST(sum(total) AS DOUBLE) / CAST(sum(covered) AS DOUBLE) AS depth FROM cut GROUP BY ALL HAVING sum(covered) > 0)"""


@register("coverage_mean", f"""WITH {EXONS}, {BLOCKS}, rg AS (SELECT DISTINCT chromosome || ':' || exon_id AS region, 0 AS side, chromosome, "start" - 20 AS s, "end" + 20 AS e FROM exons), {DEPTH} SELECT region, round(depth, 6) AS depth FROM dep""")
def _(spark, sf):
    regions = views.exons(spark, sf).select(F.concat_ws(":", "chromosome", "exon_id").alias("region"), "chromosome", (F.col("start") - 20).alias("start"), (F.col("end") + 20).alias("end")).distinct()
    return retention.mean_depth(regions, views.blocks(spark, sf)).select("region", F.round("depth", 6).alias("depth"))


@register("ir_psi", f"""WITH {ALL}, {BLOCKS}, iv AS (SELECT DISTINCT chromosome, "start" AS s, "end" AS e FROM junctions),
rg AS (SELECT chromosome || ':' || s || '-' || e AS region, 'in' AS side, chromosome, s, e FROM iv UNION ALL SELECT chromosome || ':' || s || '-' || e, 'out', chromosome, s - 20, s - 1 FROM iv UNION ALL SELECT chromosome || ':' || s || '-' || e, 'out', chromosome, e + 1, e + 20 FROM iv), {DEPTH}
SELECT r.region, round(i.depth / o.depth, 6) AS psi FROM (SELECT DISTINCT region FROM rg) r LEFT JOIN dep i ON i.region = r.region AND i.side = 'in' LEFT JOIN dep o ON o.region = r.region AND o.side = 'out'""")
def _(spark, sf):
    name = F.concat("chromosome", F.lit(":"), "start", F.lit("-"), "end")
    regions = written(views.junctions(spark, sf).select("chromosome", "start", "end").distinct(), "regions")
    found = retention.depth_ratio(regions, views.blocks(spark, sf), by=["chromosome", "start", "end"])
    return found.select(name.alias("region"), F.round("psi", 6).alias("psi"))


@register("read_introns_to_exons", f"""WITH {READS} SELECT name, unnest(range(1, n + 1)) AS nth, CAST(unnest(parts) * 40 + 91 AS INT) AS "start", CAST(unnest(parts) * 40 + 99 AS INT) AS "end" FROM reads""")
def _(spark, sf):
    each = views.reads(spark, sf).select("name", F.posexplode("exons").alias("nth", "x"))
    return each.select("name", (F.col("nth") + 1).cast("long").alias("nth"), "x.start", "x.end")


#: Transcripts of runs of parts, so that reads of a few neighbouring parts can match them.
TRANSCRIPTS = """tr AS (SELECT a.p_partkey || '.' || k || '|' || chromosome || '|' || strand AS transcript, chromosome, strand, range(a.p_partkey, a.p_partkey + k) AS ps FROM part a, (VALUES (20), (60), (140)) v(k), (VALUES ('1'), ('2'), ('3'), ('4'), ('5')) c(chromosome), (VALUES ('+'), ('-')) s(strand)),
tx AS (SELECT transcript, chromosome, strand, CAST(ps[1] * 40 + 91 AS INT) AS s, CAST(ps[-1] * 40 + 99 AS INT) AS e, ps FROM tr),
cp AS (SELECT r.sample, r.name, t.transcript, r.parts, r.chromosome, r.strand, (least(r."end", t.e) - greatest(r."start", t.s)) * 100.0 / (greatest(r."end", t.e) - least(r."start", t.s)) AS pc FROM reads r JOIN tx t ON r.chromosome = t.chromosome AND r.strand = t.strand AND r."start" <= t.e AND r."end" >= t.s
  WHERE (least(r."end", t.e) - greatest(r."start", t.s)) * 100.0 >= 60 * (greatest(r."end", t.e) - least(r."start", t.s)) AND len(list_intersect(r.parts, t.ps)) >= 1)"""
READ_PERCENT = 60.0


def part_exon(p):
    return F.struct((p * 40 + 91).cast("int").alias("start"), (p * 40 + 99).cast("int").alias("end"), F.concat(F.lit("E"), p.cast("string")).alias("exon_id"))


def part_transcripts(spark: SparkSession, sf: str) -> DataFrame:
    """Transcripts of 20, 60 and 140 parts from every part on, without their exons (``part_exons``)."""
    rows = views.parts(spark, sf).select("p_partkey", F.explode(F.array(F.lit(20), F.lit(60), F.lit(140))).alias("k"))
    rows = rows.withColumn("chromosome", F.explode(F.array(*[F.lit(str(c)) for c in range(1, 6)]))).withColumn("strand", F.explode(F.array(F.lit("+"), F.lit("-"))))
    name = F.concat_ws("|", F.concat_ws(".", "p_partkey", "k"), "chromosome", "strand")
    first, last = part_exon(F.col("p_partkey")), part_exon(F.col("p_partkey") + F.col("k") - 1)
    return rows.select(name.alias("transcript"), F.col("p_partkey").cast("string").alias("gene"), "chromosome", "strand", first["start"].alias("start"), last["end"].alias("end"), "p_partkey", "k")


def part_exons():
    return F.transform(F.sequence("p_partkey", F.col("p_partkey") + F.col("k") - 1), part_exon)


def coupled(spark: SparkSession, sf: str) -> DataFrame:
    return coupling.couple(part_transcripts(spark, sf), views.reads(spark, sf), 3, READ_PERCENT, part_exons())


@register("read_transcript_coupling", f"WITH {READS}, {TRANSCRIPTS} SELECT sample, name, transcript, round(pc, 6) AS overlap FROM cp")
def _(spark, sf):
    return coupled(spark, sf).select("sample", "name", "transcript", F.round("overlap", 6).alias("overlap"))


@register("novel_reads", f"WITH {READS}, {TRANSCRIPTS} SELECT sample, name FROM reads r WHERE NOT EXISTS (SELECT 1 FROM cp WHERE cp.name = r.name)")
def _(spark, sf):
    return coupling.novel_reads(views.reads(spark, sf), coupled(spark, sf)).select("sample", "name")


@register("read_summary", f"WITH {READS}, {TRANSCRIPTS} SELECT sample, count(*) AS total, count(*) FILTER (name IN (SELECT name FROM cp)) AS coupled, count(*) FILTER (name NOT IN (SELECT name FROM cp)) AS novel FROM reads GROUP BY sample")
def _(spark, sf):
    return coupling.read_summary(views.reads(spark, sf), coupled(spark, sf))


@register("template_sizes", f"WITH {READS}, {TRANSCRIPTS} SELECT sample, transcript, count(*) AS n_reads FROM cp GROUP BY ALL")
def _(spark, sf):
    return coupling.templates(coupled(spark, sf)).select("sample", "transcript", "n_reads")


@register("template_events", f"""WITH {READS}, {TRANSCRIPTS}, ij AS (SELECT sample || '|' || transcript AS sample, chromosome, strand, parts, unnest(range(1, len(parts))) AS x FROM cp WHERE len(parts) > 1),
junctions AS (SELECT sample, chromosome, strand, CAST(parts[x] * 40 + 100 AS INT) AS "start", CAST(parts[x + 1] * 40 + 90 AS INT) AS "end", count(*) AS "count" FROM ij GROUP BY ALL), {PSI}, {SE}, {ALT}, {MXE}
SELECT {OUT} FROM (SELECT * FROM se UNION ALL SELECT * FROM alt UNION ALL SELECT * FROM alt2 UNION ALL SELECT * FROM mxe)""")
def _(spark, sf):
    return shown(coupling.template_events(coupled(spark, sf)).withColumn("sample", F.concat_ws("|", "sample", "transcript")))


@register("annotated_template_events", f"""WITH {READS}, {TRANSCRIPTS}, ij AS (SELECT sample || '|' || transcript AS sample, chromosome, strand, parts, unnest(range(1, len(parts))) AS x FROM cp WHERE len(parts) > 1),
junctions AS (SELECT sample, chromosome, strand, CAST(parts[x] * 40 + 100 AS INT) AS "start", CAST(parts[x + 1] * 40 + 90 AS INT) AS "end", count(*) AS "count" FROM ij GROUP BY ALL), {PSI}, {SE}, {ALT}, {MXE},
ev AS (SELECT * FROM se UNION ALL SELECT * FROM alt UNION ALL SELECT * FROM alt2 UNION ALL SELECT * FROM mxe),
tex AS (SELECT transcript, p * 40 + 91 AS xs, p * 40 + 99 AS xe, 'E' || p AS exon_id, split_part(transcript, '.', 1) AS gene FROM (SELECT transcript, unnest(ps) AS p FROM tr)),
m AS (SELECT ev.*, e.* FROM ev JOIN tex e ON e.transcript = substr(ev.sample, 3) AND CASE event WHEN 'SE' THEN "start" <= xs AND "end" >= xe WHEN 'MXE' THEN (sites[2] <= xs AND sites[3] >= xe) OR (sites[4] <= xs AND sites[5] >= xe)
  ELSE CASE WHEN sites[1] = sites[2] THEN abs(sites[3] - xs) <= 3 OR abs(sites[4] - xs) <= 3 ELSE abs(sites[1] - xe) <= 3 OR abs(sites[2] - xe) <= 3 END END),
k AS (SELECT *, CASE WHEN abs("start" - xs) <= 1 AND abs("end" - xe) <= 1 THEN 'exact' WHEN abs("start" - xs) <= 1 OR abs("end" - xe) <= 1 THEN 'part' ELSE 'other' END AS kind, sites[2] <= xs AND sites[3] >= xe AS in1, sites[4] <= xs AND sites[5] >= xe AS in2 FROM m),
f AS (SELECT sample, event, chromosome, "start", "end", strand, sites, CASE WHEN event <> 'SE' THEN 'NA' WHEN count(DISTINCT kind) = 1 THEN min(kind) ELSE 'single' END AS subtype, event = 'MXE' AND NOT (bool_or(in1) AND bool_or(in2)) AS is_novel,
  list(DISTINCT exon_id ORDER BY exon_id) AS exons, list(DISTINCT gene ORDER BY gene) AS genes, list(DISTINCT transcript ORDER BY transcript) AS transcripts FROM k GROUP BY sample, event, chromosome, "start", "end", strand, sites),
a AS (SELECT substr(ev.sample, 1, 1) AS sample, ev.event, ev.chromosome, ev."start", ev."end", ev.strand, ev.sites, ev.psi, coalesce(f.subtype, 'NA') AS subtype, coalesce(f.is_novel, true) AS is_novel, f.exons, f.genes, f.transcripts
  FROM ev LEFT JOIN f ON ev.sample = f.sample AND ev.event = f.event AND ev.chromosome = f.chromosome AND ev.strand = f.strand AND ev.sites = f.sites AND ev."start" = f."start" AND ev."end" = f."end"),
b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY sample, event, chromosome, "start", "end", strand, sites ORDER BY is_novel, transcripts NULLS FIRST, exons NULLS FIRST, psi) = 1)
SELECT sample, event, chromosome, "start", "end", strand, array_to_string(sites, '-') AS sites, round(psi, 6) AS psi, subtype, is_novel, coalesce(array_to_string(exons, ','), 'NA') AS exons, coalesce(array_to_string(genes, ','), 'NA') AS genes, coalesce(array_to_string(transcripts, ','), 'NA') AS transcripts FROM b""")
def _(spark, sf):
    pairs = written(coupled(spark, sf), "coupled")
    own = part_transcripts(spark, sf).join(pairs.select("transcript").distinct(), "transcript", "left_semi")
    each = own.select("transcript", "gene", "chromosome", "strand", F.explode(part_exons()).alias("x"))
    exons = each.select("transcript", "gene", "chromosome", "x.start", "x.end", "strand", "x.exon_id")
    return annotated(coupling.annotated_template_events(pairs, exons))


UNIFY = f"""WITH RECURSIVE {READS}, o AS (SELECT sample, name, chromosome, strand, "start", "end", n, parts, row_number() OVER (PARTITION BY sample, chromosome, "start" ORDER BY "end", n, parts, strand, name) AS k FROM reads),
f AS (SELECT sample, chromosome, "start", k, name, name AS leader, strand AS ls, "end" AS le, n AS ln, parts AS lp FROM o WHERE k = 1
  UNION ALL SELECT o.sample, o.chromosome, o."start", o.k, o.name, CASE WHEN same THEN leader ELSE o.name END, CASE WHEN same THEN ls ELSE o.strand END, CASE WHEN same THEN le ELSE o."end" END, CASE WHEN same THEN ln ELSE o.n END, CASE WHEN same THEN lp ELSE o.parts END
  FROM (SELECT o.*, f.leader, f.ls, f.le, f.ln, f.lp, f.ls = o.strand AND f.ln = o.n AND abs(f.le - o."end") < 3 AND (o.n = 1 OR len(list_filter(range(1, o.n), lambda i: f.lp[i] = o.parts[i])) > 0) AS same FROM f JOIN o ON f.sample = o.sample AND f.chromosome = o.chromosome AND f."start" = o."start" AND o.k = f.k + 1) o)"""


@register("isoform_unify", f"{UNIFY} SELECT sample, name, leader FROM f")
def _(spark, sf):
    return isoforms.unify(views.reads(spark, sf)).select("sample", "name", "leader")


@register("isoform_gtf", f"""{UNIFY}, top AS (SELECT o.* FROM o JOIN f ON o.name = f.name WHERE f.leader = f.name),
each AS (SELECT *, CAST(unnest(range(0, n + 1)) AS INT) AS i FROM top)
SELECT concat_ws(chr(9), chromosome, 'isoframe', CASE i WHEN 0 THEN 'transcript' ELSE 'exon' END, CASE i WHEN 0 THEN "start" ELSE parts[i] * 40 + 91 END, CASE i WHEN 0 THEN "end" ELSE parts[i] * 40 + 99 END, '.', strand, '.',
  'gene_id "' || name || '"; transcript_id "' || name || '";' || CASE i WHEN 0 THEN '' ELSE ' exon_id "' || name || '.' || i || '";' END) AS value FROM each""")
def _(spark, sf):
    return isoforms.to_gtf(isoforms.isoforms(isoforms.unify(views.reads(spark, sf)))).select("value")


@register("event_report", f"""WITH {BY_SAMPLE}, {PSI}, {SE}, {EXONS}, ev AS (SELECT chromosome, "start", "end", strand, sites, {", ".join(f"max(psi) FILTER (sample = '{s}') AS {s}" for s in SAMPLES)} FROM se GROUP BY ALL),
m AS (SELECT ev.*, exon_id, gene, transcript, CASE WHEN abs(ev."start" - e."start") <= 1 AND abs(ev."end" - e."end") <= 1 THEN 'exact' WHEN abs(ev."start" - e."start") <= 1 OR abs(ev."end" - e."end") <= 1 THEN 'part' ELSE 'other' END AS kind FROM ev JOIN exons e ON ev.chromosome = e.chromosome AND ev.strand = e.strand AND ev."start" <= e."start" AND ev."end" >= e."end"),
f AS (SELECT chromosome, "start", "end", strand, sites, CASE WHEN count(DISTINCT kind || '|' || transcript) = 1 THEN min(kind) WHEN count(DISTINCT transcript) = 1 THEN 'single' ELSE 'multi' END AS subtype, {SETS} FROM m GROUP BY chromosome, "start", "end", strand, sites)
SELECT chromosome || ':' || sites[1] || '-' || sites[4] || strand AS spliceRange, 'SE' AS spliceType, coalesce(subtype, 'NA') AS subtype, chromosome || ':' || array_to_string(sites, '-') AS spliceSites, CASE WHEN subtype IS NULL THEN 1 ELSE 0 END AS isNovel,
  coalesce(genes, 'NA') AS gene, coalesce(transcripts, 'NA') AS transcript, coalesce(exons, 'NA') AS exon, {", ".join(f"CASE WHEN {s} IS NULL THEN 'NA' ELSE printf('%.3f', round({s} + 1e-12, 3)) END AS {s}" for s in SAMPLES)}
FROM ev LEFT JOIN f USING (chromosome, "start", "end", strand, sites)""")
def _(spark, sf):
    found = events.skipped_exons(psi.with_psi(views.junctions(spark, sf, True)))
    return report.event_table(annotate.annotate_skipped(found, views.exons(spark, sf), BIN), SAMPLES)


CIGARS = """c AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, CAST(l_partkey AS INT) % 90 + 10 AS a, CAST(l_quantity AS INT) AS b, CAST(l_suppkey AS INT) % 7 + 1 AS d FROM lineitem)"""


def cigars(spark: SparkSession, sf: str) -> DataFrame:
    """Alignments aM bN dI aM dD 10M 50N 5M 3S at place 1000 + partkey, made from line items."""
    rows = views.table(spark, sf, "lineitem").selectExpr("l_orderkey AS k", "l_linenumber AS n", "CAST(1000 + l_partkey AS INT) AS pos", "CAST(l_partkey AS INT) % 90 + 10 AS a", "CAST(l_quantity AS INT) AS b", "CAST(l_suppkey AS INT) % 7 + 1 AS d")
    return rows.withColumn("cigar", F.expr("concat(a, 'M', b, 'N', d, 'I', a, 'M', d, 'D10M50N5M3S')"))


@register("cigar_introns", f"""WITH {CIGARS} SELECT k, n, CAST(1000 + p + a AS INT) || '-' || CAST(1000 + p + a + b - 1 AS INT) || ',' || CAST(1000 + p + 2 * a + b + d + 10 AS INT) || '-' || CAST(1000 + p + 2 * a + b + d + 59 AS INT) AS introns, CAST(1000 + p + 2 * a + b + d + 64 AS INT) AS read_end FROM c""")
def _(spark, sf):
    rows = cigars(spark, sf).select("k", "n", cg.walk(F.col("cigar"), F.col("pos")).alias("walk"))
    shown_ = F.array_join(F.transform("walk.found", lambda x: F.concat(x["start"], F.lit("-"), x["end"])), ",")
    return rows.select("k", "n", shown_.alias("introns"), (F.col("walk.pos") - 1).alias("read_end"))


@register("cigar_blocks", f"""WITH {CIGARS} SELECT k, n, 1000 + p || '-' || (1000 + p + a - 1) || ',' || (1000 + p + a + b) || '-' || (1000 + p + 2 * a + b - 1) || ',' || (1000 + p + 2 * a + b + d) || '-' || (1000 + p + 2 * a + b + d + 9) || ',' || (1000 + p + 2 * a + b + d + 60) || '-' || (1000 + p + 2 * a + b + d + 64) AS blocks FROM c""")
def _(spark, sf):
    shown_ = F.array_join(F.transform(cg.blocks(F.col("cigar"), F.col("pos")), lambda x: F.concat(x["start"], F.lit("-"), x["end"])), ",")
    return cigars(spark, sf).select("k", "n", shown_.alias("blocks"))


@register("sam_reads", f"""WITH {CIGARS} SELECT 'r' || k || '.' || n AS name, 'X' AS chromosome, CAST(1000 + p AS INT) AS "start", CAST(1000 + p + 2 * a + b + d + 64 AS INT) AS "end", CASE WHEN n % 4 IN (1, 2) THEN '-' ELSE '+' END AS strand, 2 AS n_introns FROM c WHERE d <> 3""")
def _(spark, sf):
    # flags by line number: 0 +, 16 -, 83 (first, mate forward) +, 147 (second, reverse) -; NH is 1 but where d is 3
    flag = F.expr("CASE n % 4 WHEN 0 THEN 0 WHEN 1 THEN 16 WHEN 2 THEN 147 ELSE 83 END")
    line = F.concat_ws("\t", F.concat(F.lit("r"), "k", F.lit("."), "n"), flag, F.lit("chrX"), "pos", F.lit("60"), "cigar", F.lit("*"), F.lit("0"), F.lit("0"), F.lit("*"), F.lit("*"), F.expr("CASE d WHEN 3 THEN 'NH:i:2' ELSE 'NH:i:1' END"))
    found = alignments.to_reads(alignments.sam_lines(cigars(spark, sf).select(F.lit("s").alias("sample"), line.alias("value"))))
    return found.select("name", "chromosome", "start", "end", "strand", F.size("introns").alias("n_introns"))


@register("alignment_text_reads", f"""WITH {READS} SELECT chromosome, strand, "start", "end", n AS n_exons FROM reads WHERE n > 1""")
def _(spark, sf):
    # reads written as alignment text, a header and an exon line each (from the right on the minus strand), and read again
    b = views.read_exons(spark, sf)
    numbers = lambda x: F.when(F.col("strand") == "-", F.concat(x["end"], F.lit("-"), x["start"])).otherwise(F.concat(x["start"], F.lit("-"), x["end"]))
    line = lambda x: F.concat(F.lit("  "), F.col("strand"), F.col("chromosome"), F.lit(":"), numbers(x), F.lit("  (1-9)   100% ->"))
    shown_ = F.transform("b", line)
    text = b.select(F.concat_ws("\n", F.concat(F.lit(">"), "name"), F.when(F.col("strand") == "-", F.reverse(shown_)).otherwise(shown_)).alias("value"))
    path = new_path(spark, "alignment_text")
    text.write.text(path)
    return alignments.read_alignment_text(spark, path).select("chromosome", "strand", "start", "end", F.size("exons").cast("long").alias("n_exons"))


@register("bam_region_reads", f"""WITH {CIGARS}, r AS (SELECT 'r' || k || '.' || n AS name, 'chr' || (1 + d % 5) AS chromosome, CAST(1000 + p * 40 AS INT) AS "start", CAST(1000 + p * 40 + 2 * a + b + d + 64 AS INT) AS "end" FROM c),
g AS (SELECT 'chr' || (1 + s_suppkey % 5) AS chromosome, s_suppkey * 700 AS a, s_suppkey * 700 + 300 AS b FROM supplier)
SELECT name, chromosome, "start", "end" FROM r WHERE EXISTS (SELECT 1 FROM g WHERE g.chromosome = r.chromosome AND r."start" <= g.b AND r."end" >= g.a)""")
def _(spark, sf):
    # line items as alignments in indexed BAM files; suppliers name the regions
    rows = cigars(spark, sf).selectExpr("concat('r', k, '.', n) AS name", "CAST(16 * (n % 2) AS INT) AS flag", "concat('chr', 1 + d % 5) AS chromosome", "CAST(1000 + 40 * (pos - 1000) AS INT) AS pos", "cigar", "1 AS nh")
    path = new_path(spark, "alignments")
    alignments.write_bam(rows, path, [(f"chr{i}", 1 << 29) for i in range(1, 6)])
    regions = views.table(spark, sf, "supplier").selectExpr("concat('chr', 1 + s_suppkey % 5) AS chromosome", "CAST(s_suppkey * 700 AS INT) AS start", "CAST(s_suppkey * 700 + 300 AS INT) AS end")
    return alignments.region_records(spark, path, regions).select("name", "chromosome", F.col("pos").alias("start"), "end")


@register("gtf_attributes", """SELECT DISTINCT p_brand AS gene, p_brand || '.' || (p_size % 3) AS transcript, 'E' || p_partkey AS exon_id, CAST(p_partkey * 40 + 91 AS INT) AS "start", CAST(p_partkey * 40 + 99 AS INT) AS "end" FROM part""")
def _(spark, sf):
    rows = views.table(spark, sf, "part").selectExpr("concat_ws('\t', 'chr1', 'x', 'exon', p_partkey * 40 + 91, p_partkey * 40 + 99, '.', '+', '.', concat('gene_id \"', p_brand, '\"; transcript_id \"', p_brand, '.', p_size % 3, '\"; note \"a; b c\"; exon_id \"E', p_partkey, '\";')) AS value")
    return annotation.gtf_exons(rows).select("gene", "transcript", "exon_id", "start", "end")


@register("gff_attributes", """SELECT DISTINCT p_brand AS gene, p_brand || '.' || (p_size % 3) AS transcript, 'E' || p_partkey AS exon_id, CAST(p_partkey * 40 + 91 AS INT) AS "start", CAST(p_partkey * 40 + 99 AS INT) AS "end" FROM part""")
def _(spark, sf):
    part = views.table(spark, sf, "part")
    exon = part.selectExpr("concat_ws('\t', 'chr1', 'x', 'exon', p_partkey * 40 + 91, p_partkey * 40 + 99, '.', '+', '.', concat('ID=exon:E', p_partkey, ';Parent=transcript:', p_brand, '.', p_size % 3)) AS value")
    owner = part.selectExpr("concat_ws('\t', 'chr1', 'x', 'mRNA', 1, 99, '.', '+', '.', concat('ID=transcript:', p_brand, '.', p_size % 3, ';Parent=gene:', p_brand)) AS value").distinct()
    return annotation.gff_exons(exon.unionByName(owner)).select("gene", "transcript", "exon_id", "start", "end")


@register("star_scan", f"""WITH {ALL} SELECT chromosome, "start", "end", strand, "count" FROM junctions""")
def _(spark, sf):
    line = F.concat_ws("  ", F.concat(F.lit("chr"), "chromosome"), "start", "end", F.when(F.col("strand") == "+", 1).otherwise(2), F.lit(1), F.lit(0), "count", F.lit(7), F.lit(30))
    return junction_files._tidy(junction_files.star_lines(views.junctions(spark, sf).select("sample", line.alias("value")))).select("chromosome", "start", "end", "strand", "count")


@register("junction_text_scan", f"""WITH {ALL} SELECT chromosome, "start", "end", strand, "count" FROM junctions""")
def _(spark, sf):
    return junction_files._tidy(junction_files.junction_lines(views.junctions(spark, sf).select("sample", tx.junction_line().alias("value")))).select("chromosome", "start", "end", "strand", "count")


@register("star_last_wins", """WITH l AS (SELECT *, CAST(1 + l_suppkey % 5 AS VARCHAR) AS chromosome, CASE l_linestatus WHEN 'O' THEN '+' ELSE '-' END AS strand, CAST(l_partkey * 40 + 100 AS INT) AS "start" FROM lineitem)
SELECT chromosome, "start", "start" + 50 AS "end", strand, CAST(arg_max(l_quantity, l_orderkey * 10 + l_linenumber) AS BIGINT) AS "count" FROM l GROUP BY chromosome, "start", strand""")
def _(spark, sf):
    # a line for each line item, in order; those of one junction are in one file
    rows = views.table(spark, sf, "lineitem").selectExpr("CAST(1 + l_suppkey % 5 AS STRING) AS c", "l_partkey * 40 + 100 AS s", "CASE l_linestatus WHEN 'O' THEN 1 ELSE 2 END AS t", "CAST(l_quantity AS INT) AS n", "l_orderkey AS k", "l_linenumber AS l")
    rows = rows.repartition("c", "s", "t").sortWithinPartitions("k", "l")
    path = new_path(spark, "star")
    rows.select(F.concat_ws("\t", F.concat(F.lit("chr"), "c"), "s", F.col("s") + 50, "t", F.lit(1), F.lit(0), "n", F.lit(7), F.lit(30)).alias("value")).write.text(path)
    return junction_files.read_star(spark, path).select("chromosome", "start", "end", "strand", "count")
