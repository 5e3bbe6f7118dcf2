"""Secret scans: fixed patterns, and strings that a primed compressor cannot shorten."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(
    r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_SENSITIVE = (
    r"(?i:password|passwd|pwd|passphrase|secret|token|api[\x20_-]?key|access[\x20_-]?key|private[\x20_-]?key|credential|bearer"
    r"|authorization|auth[\x20_-]?key|client[\x20_-]?id|signature|session[\x20_-]?id)"
)
_CONTEXT = re.compile(_SENSITIVE, re.ASCII)
# a value that the text says to be the word's: "secret key is ...", "credential: ..."
_STATED = re.compile(
    _SENSITIVE + r"""s?(?:[\x20_-]?(?i:key|id|value|string|phrase|code))?["'`]?\s{0,4}(?:is|was|are|[:=]=?>?|->)\s{0,4}["'`]?([^\s"'`<>]{8,})""",
    re.ASCII,
)
_LOGIN = re.compile(r"""://[^\s/:@"'<>]{1,256}:([^\s/@"'<>]{6,})@""")
_RUN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=~-]{16,}")
# the last line of a key in text form, which may be short
_LAST_LINE = re.compile(r"\s{1,8}([A-Za-z0-9+/=]{1,15})(?=\s{1,8}-----END)")

# One of these, in lower case, is in every match of the two patterns above.
_ASSIGN_STEMS = ("passw", "secret", "token", "apikey", "api_key")
_STEMS = (*_ASSIGN_STEMS, "pwd", "passphrase", "api-key", "api key", "access", "private", "credential", "bearer", "auth", "client", "signature", "session")

CONTEXT_CHARS = 48
AROUND_CHARS = 256
# Random letters and digits add 0.65 bytes a character (one case, among many like them) and more; names made of words 0.5 to 0.9,
# like random letters of one case.
MIN_NOVELTY = 0.6
MIN_WORD_NOVELTY = 0.92
# What code and its identifiers are made of; primes the compressor.
DICTIONARY = (
    """function return const let var import export default class public private protected static void string number boolean
    true false null undefined None self this def for while if else elif switch case break continue try catch except finally
    throw raise async await yield lambda struct interface extends implements package namespace using include require module
    username user_name password passwd passphrase secret secret_key secretKey token access_token accessToken refresh_token
    refreshToken id_token api_key apiKey API_KEY access_key access_key_id AWS_ACCESS_KEY_ID AWS_SECRET_ACCESS_KEY private_key
    privateKey public_key publicKey client_id clientId client_secret clientSecret credential credentials authorization
    Authorization Bearer Basic session session_id sessionId cookie signature certificate config configuration settings
    environment process.env database connection connection_string host hostname localhost port endpoint service server client
    request response header headers Content-Type application/json https:// http:// www. .com .org .net index main util utils
    helper helpers manager controller handler factory builder provider repository component container instance example sample
    test testing placeholder changeme your_api_key_here xxxxxxxxxxxxxxxx 0123456789 1234567890 abcdefghijklmnopqrstuvwxyz
    ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789abcdef the and that with this from have which their there"""
    # parts of ordinary words
    """ inter over under trans super counter multi micro photo auto tele semi anti pre pro sub dis mis non out up re de en un in
    ally ation ition ution isation ization ational ment mental ness less ful able ible ability ibility ology ological graph
    graphic meter metric sphere scope ance ence ancy ency ious eous tive sive ative ised ized ising izing ifying ified ships
    wards other about would people time year work great world life over after under again still country state never school
    house between through where before while should because water number place right great small large every found those
    large often together group important until children side feet land white light night river letter mother father plant
    paper music book voice story point city play learn stand follow begin press close real open seem hard start might
    present record document page language national market product report history system program question government
    company service power point week month money minute measure picture notice strong table travel different""",
)
DICTIONARY = " ".join(" ".join(DICTIONARY).split()).encode()


@lru_cache(1)
def _compressor() -> zstandard.ZstdCompressor:
    primed = zstandard.ZstdCompressionDict(DICTIONARY, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=19, dict_data=primed, write_checksum=False, write_content_size=False)


def novelty(before: str, candidate: str, after: str) -> float:
    """Compressed bytes that ``candidate`` adds to the text around it, per byte of its own."""
    squeeze = _compressor().compress
    around = f"{before}\n{after}\n"
    return (len(squeeze((around + candidate).encode())) - len(squeeze(around.encode()))) / len(candidate)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns by begin, then kind; matches that are too short are dropped."""
    found = []
    low = text.lower()
    if any(stem in low for stem in _ASSIGN_STEMS):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


class _Places:
    """Spans merged, to ask whether a place is free of them or held by them."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        self.begins, self.ends = [], []
        for _, begin, end in sorted(spans, key=lambda s: s[1]):
            if self.ends and begin < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.begins.append(begin)
                self.ends.append(end)

    def free(self, begin: int, end: int) -> bool:
        at = bisect_right(self.ends, begin)
        return at == len(self.begins) or self.begins[at] >= end

    def holds(self, begin: int, end: int) -> bool:
        at = bisect_right(self.begins, begin) - 1
        return at >= 0 and end <= self.ends[at]


def _like_words(value: str) -> bool:
    """Whether most of a string is letters in runs as long as words, such as ``long_client_names`` or ``Section-4``."""
    runs = _RUN.findall(value)
    letters = sum(map(len, runs))
    return 2 * letters > len(value) and letters >= 3.5 * len(runs)


def _kinds(value: str) -> int:
    """How many of small letters, capitals, digits and other characters are in a string."""
    return any(c.islower() for c in value) + any(c.isupper() for c in value) + any(c.isdigit() for c in value) + (not value.isalnum())


def novel_spans(
    text: str, base: list[tuple[str, int, int]], min_novelty: float = MIN_NOVELTY, min_word_novelty: float = MIN_WORD_NOVELTY
) -> list[tuple[str, int, int]]:
    """Strings in a sensitive place that do not compress, and that base spans do not hold.

    Near is within ``CONTEXT_CHARS`` after the word or before it, or after the last string found after it, so that
    values of several parts or lines are found as a whole. Values stated to be the word's may be shorter and hold any
    character, if they mix three kinds; so may passwords in addresses.
    """
    found, last = [], 0
    low = text.lower()

    def secret(begin: int, end: int) -> bool:
        value = text[begin:end]
        if len(value) < 16 and _like_words(value):
            # too short for its compressed size to tell
            return False
        around = text[max(0, begin - AROUND_CHARS) : begin], text[end : end + AROUND_CHARS]
        return novelty(around[0], value, around[1]) >= (min_word_novelty if _like_words(value) else min_novelty)

    fixed = _Places(base)
    if "://" in text:
        for m in _LOGIN.finditer(text):
            if not fixed.holds(*m.span(1)) and secret(*m.span(1)):
                found.append(("novel", *m.span(1)))
    if not any(stem in low for stem in _STEMS):
        return found
    taken = _Places(found)
    for m in _STATED.finditer(text):
        value = m[1].rstrip(".,;:!?)]}")
        begin, end = m.start(1), m.start(1) + len(value)
        if len(value) < 8 or _kinds(value) < 3 or "://" in value or _CANDIDATE.fullmatch(value):
            continue
        if taken.free(begin, end) and not fixed.holds(begin, end) and secret(begin, end):
            found.append(("novel", begin, end))
    taken = _Places(found + base)

    following = None
    for word in _CONTEXT.finditer(text):
        # a string that ends at the word itself is the word's own name
        for m in _CANDIDATE.finditer(text, last, word.start()) if last < word.start() else ():
            last = m.end() if m.end() < word.start() - CONTEXT_CHARS else last
            if word.start() - CONTEXT_CHARS <= m.end() < word.start():
                last = m.end()
                if taken.free(*m.span()) and secret(*m.span()):
                    found.append(("novel", *m.span()))
        reach = word.end() + CONTEXT_CHARS
        # a string that begins within reach is taken to its end
        at = max(word.end(), last)
        while True:
            # the text is searched once: a string found for an earlier word serves until its begin is passed
            if following is None or following.start() < at:
                if (following := _CANDIDATE.search(text, at)) is None:
                    return found
            m = following
            if m.start() > reach:
                break
            at = last = m.end()
            value = m[0]
            # letters that go on from the word are its name: accessTokenProviderFactory
            if m.start() == word.end() and value[0].isalpha() and not any(c.isdigit() for c in value):
                continue
            if taken.free(*m.span()) and secret(*m.span()):
                found.append(("novel", *m.span()))
                reach = max(reach, at + CONTEXT_CHARS)
                if tail := _LAST_LINE.match(text, at):
                    at = last = tail.end(1)
                    found.append(("novel", *tail.span(1)))
        last = max(last, word.end())
    return found


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{b}:{e}" for k, b, e in spans)


def redacted(text: str, spans: list[tuple[str, int, int]], mark: str) -> str:
    """``text`` with every span replaced; spans that overlap are replaced as one."""
    out, at = [], 0
    for _, begin, end in sorted(spans, key=lambda s: s[1]):
        if begin >= at:
            out += [text[at:begin], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def scan_secrets(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    min_novelty: float = MIN_NOVELTY,
    min_word_novelty: float = MIN_WORD_NOVELTY,
    redact: str | None = None,
    keep_row: bool = False,
) -> DataFrame:
    """Finds secrets in every whole text.

    Three fixed patterns give the base: assignments to a secret's name, access keys, long hexadecimal
    strings. Besides, every string of 16 or more key characters within 48 characters of a
    sensitive word, on either side, or of the last one found after it, every value stated to be the word's (8 or more
    characters of three kinds) and every password in an address (6 or more) is compressed after the text
    around it (256 characters on each side, so that the work for a string is bounded) by zstandard,
    primed with words of code; it is reported as ``novel`` if it adds at least ``min_novelty`` compressed
    bytes per character, or ``min_word_novelty`` if it is letters in runs as long as words (such strings below 16 characters
    never are). Keys of letters of one case cannot be told from such names and are mostly left.

    Returns ``doc_id``, ``n_assign``, ``n_access``, ``n_hex``, ``n_novel``, ``base_spans`` and ``spans``
    (``kind:start:end`` by start, then kind, joined by commas; code points, end exclusive), ``redacted``
    (the text with spans replaced by ``redact``; the text itself if that is None), and with ``keep_row``
    the struct ``row`` of the other columns. Null and empty texts have no spans; a null text stays null.
    Repeated rows stay; an empty table gives no rows; other columns are not read, whatever their names.
    """
    chosen = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(text).alias("text"),
        *([F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text)).alias("row")] if keep_row else []),
    )
    schema = chosen.drop("text").schema
    for name, kind in (
        *((f"n_{k}", "long") for k in KINDS),
        ("base_spans", "string"),
        ("spans", "string"),
        ("redacted", "string"),
    ):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[] for _ in KINDS]
            base_text, all_text, clean = [], [], []
            for t in batch.column("text").to_pylist():
                base = base_spans(t or "")
                novel = novel_spans(t or "", base, min_novelty, min_word_novelty)
                spans = sorted(base + novel, key=lambda s: (s[1], KINDS.index(s[0])))
                for k, kind in enumerate(KINDS):
                    counts[k].append(sum(s[0] == kind for s in spans))
                base_text.append(joined(base))
                all_text.append(joined(spans))
                clean.append(t if t is None or redact is None or not spans else redacted(t, spans, redact))
            kept = [batch.column(i) for i, f in enumerate(batch.schema.names) if f != "text"]
            names = [f for f in batch.schema.names if f != "text"]
            yield pa.RecordBatch.from_arrays(
                [*kept, *(pa.array(c, pa.int64()) for c in counts), *(pa.array(x, pa.string()) for x in (base_text, all_text, clean))],
                [*names, *(f"n_{k}" for k in KINDS), "base_spans", "spans", "redacted"],
            )

    return chosen.mapInArrow(run, schema)
