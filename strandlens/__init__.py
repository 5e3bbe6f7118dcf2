"""Quality control of long-read sequencing data as Spark DataFrame jobs.

Sub-packages:

* ``sources``   – readers and writers: FASTQ, SAM, VCF, BED, GFF3, run logs, headers, QC reports
* ``functions`` – column expressions: qualities, cigars, tags, regions, variant classes
* ``operators`` – DataFrame in, DataFrame out: statistics, histograms, depth, joins
* ``plans``     – reports put together from several operators, and the named presets

Every operator takes ``by``, the columns that tell inputs apart (``("file",)`` unless given),
so that one job handles any number of files at once.
"""

from strandlens.session import configure, scratch_dir

__all__ = ["configure", "scratch_dir"]
