"""The alignment schema: one row for each record, 0-based half-open coordinates, -1 for none."""

from __future__ import annotations

TAG = "struct<name:string,type:string,subtype:string,i:bigint,f:float,s:string,ia:array<bigint>,fa:array<float>>"
ALIGNMENTS = f"qname string, flag int, ref_id int, rname string, start int, `end` int, bin int, mapq int, cigar string, mate_ref_id int, mate_start int, tlen int, seq string, qual string, tags array<{TAG}>, _corrupt string"
COLUMNS = [c.strip().split(" ")[0].strip("`") for c in ALIGNMENTS.split(f"array<{TAG}>")[0].split(",")[:-1]] + ["tags", "_corrupt"]
