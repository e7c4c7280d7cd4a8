"""Schemas of the tables that the engine reads and makes."""

PETS = "file string, anchor_chr string, target_chr string, anchor_pos int, target_pos int"
LENGTHS = "chr string, length int, header_ord int"
REGIONS = "region_id long, chr string, start int, end int, original long"
ALIGNMENTS = "qname string, ord long, flag int, rname string, pos int, qwidth int, mapq int"
READ_PAIRS = "pair_id long, header1 string, seq1 string, plus1 string, qual1 string, header2 string, seq2 string, plus2 string, qual2 string"
