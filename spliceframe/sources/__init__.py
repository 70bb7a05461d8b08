"""Sources and sinks: GTF, SAM, FASTA, small tables, tab-separated results."""
