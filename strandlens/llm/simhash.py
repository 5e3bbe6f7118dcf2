"""SimHash near-duplicates: byte-position inverted index with count filtering."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlens.llm.common import broadcast_if_small, discard, join_skewed, written
from strandlens.llm.graph import connected

WORDS = 4
SEED = 42
BYTES = 8
MAX_BITS = 4
# up to 4 differing bits touch up to 4 bytes, so at least 4 of the 8 bytes are shared at their positions
MIN_SHARED = BYTES - MAX_BITS
LIST_BLOCK = 1024
SMALL_LIST = 16
PIECE_BYTES = 1 << 20
SHINGLES_AT_ONCE = 1 << 15

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _word_lists(text: bytes, keep: int) -> Iterator[list[bytes]]:
    """Words of a text (A-Z as a-z) in pieces of bounded size, each with the last ``keep`` words of the one before."""
    at, kept = 0, []
    while at < len(text):
        space = _SPACE.search(text, at + PIECE_BYTES)
        end = space.start() if space else len(text)
        # bytes.split() parts at exactly space, tab and the line breaks 0x0A to 0x0D
        words = kept + text[at:end].translate(_LOWER).split()
        yield words
        kept = words[len(words) - keep :] if len(words) > keep else words
        at = end


def _hashes(words: list[bytes], n: int) -> Iterator[np.ndarray]:
    """XXH64 of all runs of ``n`` words, joined by one space, some thousand at a time."""
    digest, joined = xxhash.xxh64_intdigest, b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.append(0, ends[:-1] + 1)
    begins, ends = begins[: len(words) - n + 1], ends[n - 1 :]
    for i in range(0, len(begins), SHINGLES_AT_ONCE):
        spans = zip(begins[i : i + SHINGLES_AT_ONCE].tolist(), ends[i : i + SHINGLES_AT_ONCE].tolist(), strict=True)
        part = begins[i : i + SHINGLES_AT_ONCE]
        yield np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(part))


def fingerprint(text: str | None, n: int = WORDS) -> int:
    """64 bits: each is 1 if it is 1 in over half of the hashes of all word n-grams, repeats counted."""
    set_bits, total, seen = np.zeros(64, np.int64), 0, 0
    last: list[bytes] = []
    for words in _word_lists((text or "").encode("utf-8", "surrogatepass"), n - 1):
        last = words
        if len(words) < n:
            continue
        for hashes in _hashes(words, n):
            set_bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            total += len(hashes)
    if not total:
        return xxhash.xxh64_intdigest(b" ".join(last), SEED) if last else 0
    return int(np.packbits(2 * set_bits > total, bitorder="little").view(np.uint64)[0])


def _fingerprints(docs: DataFrame, n: int) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            found = np.fromiter((fingerprint(texts[i].as_py(), n) for i in range(len(texts))), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.mapInArrow(run, f"doc_id {kind}, fp bigint")


def _index_terms() -> list[tuple[int, int, int]]:
    """Sets of three positions such that any four shared positions contain one of them.

    Positions are dealt to three groups; a term lies in one group, or has two positions in one and one in the
    next. Four positions have two in common groups often enough that one of these 20 terms is always inside.
    """
    group = [p % 3 for p in range(BYTES)]
    terms = []
    for a in range(BYTES):
        for b in range(a + 1, BYTES):
            for c in range(b + 1, BYTES):
                counts = [[group[x] for x in (a, b, c)].count(g) for g in range(3)]
                if 3 in counts or any(counts[g] == 2 and counts[(g + 1) % 3] == 1 for g in range(3)):
                    terms.append((a, b, c))
    return terms


TERMS = _index_terms()


def _first_terms() -> np.ndarray:
    """For each set of shared positions (a byte of bits) the first term inside; 255 where fewer than the minimum are shared."""
    first = np.full(256, 255, np.uint8)
    for shared in range(256):
        if shared.bit_count() >= MIN_SHARED:
            first[shared] = next(i for i, t in enumerate(TERMS) if all(shared >> p & 1 for p in t))
    return first


FIRST_TERM = _first_terms()


def _postings(fps: DataFrame) -> DataFrame:
    """The inverted index: ``key`` (term and the three bytes there) and ``fp``."""

    def byte(p: int) -> Column:
        return F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(0xFF))

    keys = [
        (F.lit(i << 24) + F.shiftleft(byte(a), 16) + F.shiftleft(byte(b), 8) + byte(c)).cast("int") for i, (a, b, c) in enumerate(TERMS)
    ]
    return fps.select("fp", F.explode(F.array(*keys)).alias("key"))


def _linked(a: np.ndarray, b: np.ndarray, term: np.ndarray | int) -> np.ndarray:
    """Whether pairs link, each counted only in the list of its first shared term.

    Shared positional bytes are tallied; pairs below the minimum go, the differing bits decide on the others.
    """
    differ = np.bitwise_xor(a, b)
    shared = np.packbits(differ.view(np.uint8).reshape(-1, BYTES) == 0, axis=1, bitorder="little")[:, 0]
    ok = FIRST_TERM[shared] == term
    ok[ok] = np.bitwise_count(differ[ok]) <= MAX_BITS
    return ok


def _forest(fp: np.ndarray, term: int, blocks: np.ndarray | None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what a long list connects, fewer than it has entries; ``blocks`` parts it in two sides."""
    found, left = [], np.arange(len(fp))
    while len(left):
        seed, left = left[0], left[1:]
        stack = [seed]
        while stack and len(left):
            i = stack.pop()
            ok = _linked(fp[left], np.full(len(left), fp[i]), term)
            if blocks is not None:
                ok &= blocks[left] != blocks[i]
            met = left[ok]
            if len(met):
                found.append((np.full(len(met), fp[seed]), fp[met]))
                stack.extend(met.tolist())
                left = left[~ok]
    return found


def _list_links(rows: pa.Table) -> pa.RecordBatch:
    """Links within whole lists, which are rows in a row."""
    key, low, high, block = (rows.column(c).to_numpy() for c in ("key", "low", "high", "block"))
    fp = rows.column("fp").to_numpy().view(np.uint64)
    begins = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])))
    sizes = np.diff(np.append(begins, len(key)))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for begin, size in zip(begins[sizes > SMALL_LIST].tolist(), sizes[sizes > SMALL_LIST].tolist(), strict=True):
        part = slice(begin, begin + size)
        sides = block[part] if low[begin] != high[begin] else None
        found += _forest(fp[part], int(key[begin]) >> 24, sides)
    # short lists all at once: each entry with the one s places on
    rest = np.flatnonzero(np.repeat(sizes <= SMALL_LIST, sizes))
    of_list = np.repeat(np.arange(len(sizes)), sizes)[rest]
    term, fp, block, two = key[rest] >> 24, fp[rest], block[rest], (low != high)[rest]
    for s in range(1, SMALL_LIST):
        at = np.flatnonzero(of_list[s:] == of_list[:-s]) if len(of_list) > s else np.zeros(0, np.int64)
        if not len(at):
            break
        ok = _linked(fp[at], fp[at + s], term[at]) & (~two[at] | (block[at] != block[at + s]))
        found.append((fp[at[ok]], fp[at[ok] + s]))
    a, b = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.uint64) for i in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])


def _links_of_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of sorted lists; a list that a batch's end cuts is carried on, which is two blocks at most."""
    carried: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        carried.append(batch)
        rows = pa.Table.from_batches(carried).combine_chunks()
        at = [rows.column(c).to_numpy() for c in ("key", "low", "high")]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in at], axis=0)) + 1
        if len(change):
            yield _list_links(rows.slice(0, change[-1]))
            carried = rows.slice(change[-1]).to_batches()
    if carried:
        yield _list_links(pa.Table.from_batches(carried))


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """Pairs ``a``, ``b`` that connect all of ``fps`` (distinct, bigint, written) with 4 or fewer differing bits.

    Any such pair shares 4 of 8 bytes at their positions, and so a term of the index. Lists of up to 1024 entries
    are one tile; longer ones go in blocks of which each meets each, so that no list is one task, and give
    links of a spanning forest, not all their pairs. Nothing is dropped.
    """
    postings = _postings(fps)
    counts = postings.groupBy("key").agg(F.count(F.lit(1)).alias("entries")).where(F.col("entries") > 1)
    lists = written(counts, "simhash-lists")
    # a term that occurs once links nothing; lists of more than a block are few and cut by their counts
    long = lists.where(F.col("entries") > LIST_BLOCK).select("key", F.ceil(F.col("entries") / LIST_BLOCK).cast("int").alias("blocks"))
    cut = postings.join(broadcast_if_small(long), "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = cut.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    sent = placed.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    at = ["key", "low", "high"]
    tiles = sent.select("key", F.least("block", "to").alias("low"), F.greatest("block", "to").alias("high"), "block", "fp")
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = tiles.repartition(tasks, *at).sortWithinPartitions(*at, "fp")
    links = written(dealt.mapInArrow(_links_of_lists, "a bigint, b bigint"), "simhash-links")
    discard(lists)
    return links


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """Components of documents whose SimHash fingerprints differ in 4 or fewer of 64 bits.

    Returns ``doc_id``, ``fingerprint`` (16 lowercase hex digits) and ``component_id`` (smallest id reachable by
    links, its own included), one row per row of ``docs``. Fingerprints count the XXH64 bits of all 4-word shingles
    of the whole text (A-Z as a-z); shorter texts are one shingle. Null, empty and blank texts have
    fingerprint zero and are linked like any other. Repeated rows and equal texts are one node of the graph. Null ids are kept and
    never the smallest, unless all are null; an empty table gives no rows; other columns are not read, whatever their names.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    marked = written(_fingerprints(docs, words), "simhash-fingerprints")
    classes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("own"), F.count(F.lit(1)).alias("rows")), "simhash-classes")
    links = fingerprint_links(classes.select("fp"))
    roots = connected(links, "simhash")
    of_class = written(classes.join(roots.toDF("fp", "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "simhash-roots")
    of_root = of_class.groupBy("root").agg(F.min("own").alias("component_id"), F.count(F.lit(1)).alias("classes"))
    named = written(join_skewed(of_class, of_root, "root", "classes").select("fp", "component_id", "rows"), "simhash-components")
    discard(links, classes)
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return join_skewed(marked, named, "fp", "rows").select("doc_id", digits.alias("fingerprint"), "component_id")
