"""Column layouts of the frames that operators exchange."""

#: A frame's partition: one splicing graph for each of these.
GRAPH = ["sample", "chromosome", "strand"]
JUNCTIONS = "sample string, chromosome string, start int, end int, strand string, count long"
READS = "sample string, name string, chromosome string, start int, end int, strand string, introns array<struct<start:int,end:int>>"
EXONS = "chromosome string, start int, end int, strand string, exon_id string, genes array<string>, transcripts array<string>"
TRANSCRIPT_EXONS = "transcript string, gene string, chromosome string, start int, end int, strand string, exon_id string"
EVENT_KEY = ["sample", "event", "chromosome", "start", "end", "strand", "sites"]
