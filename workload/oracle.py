"""SQL of the derived views, to put in front of an oracle query as common table expressions."""

from __future__ import annotations

from workload.views import BASES, LOWER, QUALITIES, UPPER

RUNS = """runs AS (
  SELECT event_type AS file, CAST(floor(value * 100) AS BIGINT) AS length,
         (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1e6 AS start_time,
         value / 10 AS qscore, user_id AS channel, event_id
  FROM events)"""

LENGTHS = "lengths AS (SELECT source AS file, n_chars AS length FROM documents)"

READS = f"""reads AS (
  SELECT source AS file, doc_id AS rec, 'd' || CAST(doc_id AS VARCHAR) AS read_id,
         regexp_replace(translate(text, '{LOWER + UPPER}', '{BASES * 2}'), '[^ACGT]', 'N', 'g') AS seq,
         regexp_replace(translate(text, '{LOWER}', '{QUALITIES}'), '[^+-D]', '5', 'g') AS qual
  FROM documents)"""

# per-read values, base by base
SCORED = f"""{READS}, scored AS (
  SELECT *, CAST(length(seq) AS BIGINT) AS len,
         CAST(len(list_filter(string_split(seq, ''), lambda c: c = 'G' OR c = 'C')) AS BIGINT) AS gc,
         -10 * log10(list_sum(list_transform(string_split(qual, ''), lambda c: pow(10.0, -(ascii(c) - 33) / 10.0)))
                     / length(qual)) AS q
  FROM reads)"""

ALN = """items AS (
  SELECT l_linestatus AS file, l_orderkey || '/' || l_linenumber || '/' || l_partkey AS qname,
         CASE WHEN l_linenumber IN (1, 7) THEN 'B' WHEN l_linenumber IN (3, 5) THEN 'C' ELSE 'A' END AS kind,
         CAST(l_linenumber AS BIGINT) AS k, CAST(l_quantity AS BIGINT) AS q, l_suppkey AS s, l_partkey AS p,
         l_discount, l_returnflag AS contig,
         CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS pos
  FROM lineitem),
aln AS (
  SELECT *, CASE k WHEN 1 THEN 67 WHEN 2 THEN 16 WHEN 3 THEN 0 WHEN 4 THEN 256 WHEN 5 THEN 16 WHEN 6 THEN 2048
              ELSE CASE WHEN s % 2 = 0 THEN 4 ELSE 1024 END END AS flag,
         s % 61 AS mapq,
         CASE kind WHEN 'A' THEN k || 'S' || q || 'M' || k || 'D' || (q + 5) || 'M2I10M'
           WHEN 'B' THEN q || 'M' ELSE q || '=1X' || q || '=' || (20 * k) || 'N7M4S3H' END AS cigar,
         CASE kind WHEN 'A' THEN k + 2 * q + 17 WHEN 'B' THEN q ELSE 2 * q + 12 END AS size,
         CASE kind WHEN 'A' THEN 2 * q + 17 WHEN 'B' THEN q ELSE 2 * q + 8 END AS len,
         CASE kind WHEN 'A' THEN 2 * q + k + 15 WHEN 'B' THEN q ELSE 2 * q + 8 + 20 * k END AS span,
         CASE kind WHEN 'A' THEN 2 ELSE 0 END AS ins, CASE kind WHEN 'A' THEN k ELSE 0 END AS del,
         CASE kind WHEN 'A' THEN 4 + k WHEN 'B' THEN 0 ELSE 1 END AS nm,
         CASE WHEN k = 1 THEN 100 * (1 - l_discount)
           ELSE CASE kind WHEN 'A' THEN 100 * (1 - 4.0 / (2 * q + 17)) WHEN 'B' THEN 100.0
                ELSE 100 * (1 - 1.0 / (2 * q + 8)) END END AS identity,
         CASE WHEN k = 1 THEN (100 + p % 400) * (CASE WHEN s % 2 = 0 THEN 1 ELSE -1 END) ELSE 0 END AS tlen,
         substr(repeat('GCATTACGGA', 14), 1 + s % 10,
                CASE kind WHEN 'A' THEN k + 2 * q + 17 WHEN 'B' THEN q ELSE 2 * q + 12 END) AS seq,
         substr(repeat('5?I+', 40), 1 + p % 4,
                CASE kind WHEN 'A' THEN k + 2 * q + 17 WHEN 'B' THEN q ELSE 2 * q + 12 END) AS qual
  FROM items)"""

# blocks from the numbers behind the cigars, not from the cigars
BLOCKS = f"""{ALN}, blocks AS (
  SELECT file, contig, pos AS s, pos + CASE kind WHEN 'C' THEN 2 * q + 1 ELSE q END AS e
  FROM aln WHERE flag & 1796 = 0
  UNION ALL
  SELECT file, contig, CASE kind WHEN 'A' THEN pos + q + k ELSE pos + 2 * q + 1 + 20 * k END,
         CASE kind WHEN 'A' THEN pos + 2 * q + k + 15 ELSE pos + 2 * q + 8 + 20 * k END
  FROM aln WHERE flag & 1796 = 0 AND kind <> 'B')"""

REFS = """refs AS (
  SELECT file, substr('ANRZY', r_regionkey + 1, 1) AS contig, CAST(4000 + 100 * r_regionkey AS BIGINT) AS length
  FROM region, (VALUES ('F'), ('O')) v(file))"""

# depth of every single base
BASES_CTE = f"""{BLOCKS}, perbase AS (
  SELECT file, contig, pos, count(*) AS depth
  FROM (SELECT file, contig, unnest(range(s, e)) AS pos FROM blocks) GROUP BY ALL)"""

ALL_BASES = f"""{BASES_CTE}, {REFS}, allbase AS (
  SELECT r.file, r.contig, r.pos, coalesce(b.depth, 0) AS depth
  FROM (SELECT file, contig, unnest(range(0, length)) AS pos FROM refs) r
  LEFT JOIN perbase b USING (file, contig, pos))"""

REGIONS = """regions AS (
  SELECT p_partkey AS line_no, substr('ANRZ', p_partkey % 4 + 1, 1) AS contig, (p_partkey * 37) % 3600 AS s,
         (p_partkey * 37) % 3600 + p_size AS e, CASE WHEN p_partkey % 5 > 0 THEN p_name END AS name
  FROM part)"""

VARIANTS = """variants AS (
  SELECT p_type AS file, p_brand AS chrom, p_partkey AS pos, p_size AS size,
         CASE p_size % 5 WHEN 3 THEN 'AT' WHEN 4 THEN 'AC' ELSE substr('ACGT', p_partkey % 4 + 1, 1) END AS ref,
         CASE p_size % 5 WHEN 3 THEN 'A' WHEN 4 THEN 'GT'
              WHEN 2 THEN substr('ACGT', p_partkey % 4 + 1, 1) || 'GG'
              ELSE substr('ACGT', (p_partkey + 1 + p_size % 3) % 4 + 1, 1) END AS alt1,
         p_partkey % 7 = 0 AS has_del, p_partkey % 9 = 0 AS has_star,
         p_size % 3 AS g1, p_partkey % 3 AS g2, p_retailprice AS qual
  FROM part)"""
