"""Mixing, sharding, url filters, pages, near copies and searches against plain versions."""

import random
import zlib
from collections import defaultdict
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from strandlens.llm import ann, exact_topk, html, mixing, ngram_join, sharding, urls
from strandlens.llm.common import SMALL_BATCHES
from strandlens.llm.queries import URL_RULES
from tests.llm.helpers import LOWER, WORD, awkward, documents, empty


def plain_sainte_lague(weights, seats, caps):
    got = [0] * len(weights)
    for _ in range(min(seats, sum(c for c, w in zip(caps, weights, strict=True) if w > 0))):
        i = max((i for i in range(len(got)) if got[i] < caps[i] and weights[i] > 0), key=lambda i: (weights[i] / (2 * got[i] + 1), -i))
        got[i] += 1
    return got


def test_sainte_lague():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randint(1, 9)
        weights = [rng.choice([0, 1, 2, 3.5, 10, 100]) for _ in range(n)]
        caps = [rng.randint(0, 40) for _ in range(n)]
        seats = rng.randint(0, 90)
        assert mixing.sainte_lague(np.array(weights), seats, np.array(caps)).tolist() == plain_sainte_lague(weights, seats, caps)


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    full, target = set(), {}
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        share = sum(weight[s] for s in names if s not in full)
        target = {s: 3.0 * sizes[s] if s in full else left * weight[s] / share for s in names}
        over = {s for s in names if target[s] > 3 * sizes[s] + 1e-9} - full
        if not over:
            return target
        full |= over


def test_mix_meets_targets(spark):
    rng = random.Random(9)
    texts = ["w " * rng.randint(0, 400) for _ in range(600)]
    sources = [None if i % 50 == 0 else "tiny" if i % 97 == 0 else f"s{i % 5}" if i % 3 else "hot" for i in range(600)]
    rows = mixing.mix_sources(documents(spark, texts, sources), shard_words=5000).collect()
    assert len(rows) == 600
    sizes = defaultdict(int)
    for s, t in zip(sources, texts, strict=True):
        sizes[s] += len(t.split())
    want, taken = plain_targets(sizes), defaultdict(int)
    for r in rows:
        assert r.size == len(texts[r.doc_id].split()) and 0 <= r.taken <= 3 * r.size
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(0.02 * t, 2 * mixing.BLOCK_WORDS), s
    again = mixing.mix_sources(documents(spark, texts, sources).repartition(7), shard_words=5000).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, again), key=repr)


def test_mix_awkward_rows(spark):
    rows = mixing.mix_sources(awkward(spark), keep_row=True).collect()
    assert len(rows) == 10 and all(0 <= r.taken <= 3 * r.size for r in rows)
    assert {r.size for r in rows if not (r.row.text or "").split()} == {0}
    assert mixing.mix_sources(empty(spark)).count() == 0
    blank = mixing.mix_sources(documents(spark, ["", None])).collect()
    assert [(r.target, r.taken) for r in blank] == [(0.0, 0), (0.0, 0)]


def smallest(sizes, shards):
    low, high = max([*sizes, -(-sum(sizes) // shards)]), sum(sizes)

    def fits(capacity):
        used, held = 1, 0
        for s in sizes:
            if held + s > capacity:
                used, held = used + 1, 0
            held += s
        return used <= shards

    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle + 1, high)
    return low


@pytest.mark.parametrize("hot", [0, 4000, 60_000])
def test_shards_are_as_small_as_can_be(spark, hot, monkeypatch):
    monkeypatch.setattr(sharding, "FETCH_GROUPS", 5)
    rng = random.Random(hot)
    texts = ["x" * rng.randint(0, 300) + str(rng.randint(0, 900)) for _ in range(900)] + ["hot"] * (hot // 4)
    rows = sharding.shard_documents(documents(spark, texts)).collect()
    assert len(rows) == len(texts)
    groups = defaultdict(int)
    keys = dict(documents(spark, texts).selectExpr("text", "xxhash64(text) AS k").distinct().collect())
    for t in texts:
        groups[keys[t]] += len(t.encode()) + 1
    best = smallest([groups[k] for k in sorted(groups)], 8)
    of_shard, slots, where = defaultdict(int), defaultdict(list), {}
    for r in rows:
        text = texts[r.doc_id]
        assert r.size == len(text.encode()) + 1 and r.text_crc32 == zlib.crc32(text.encode()) and r.law == "bytes"
        assert where.setdefault(text, r.shard) == r.shard and 0 <= r.shard < 8
        of_shard[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert max(of_shard.values()) <= best
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_awkward_rows(spark):
    rows = sharding.shard_documents(awkward(spark), keep_row=True).collect()
    assert len(rows) == 10
    assert all((r.text_crc32 is None) == (r.row.text is None) for r in rows)
    assert len({(r.shard, r.slot) for r in rows}) == 10
    assert len({r.shard for r in rows if r.row.text is None}) == 1
    assert sharding.shard_documents(empty(spark)).count() == 0


URLS = [
    None, "", "no scheme", "http://", "http://EXAMPLE.org/es/x", "https://a.example.org/en/1?x=/y", "https://a.example.org/en/2#z",
    "https://myexample.org/es/", "https://example.org?q", "https://x.com/fr/", "https://x.com/de/1", "https://com/fr/", "https://x.com/de",
    "https://a.b.org", "https://a.b.org/", "x://y://org/z", "https://org:80/", "https://x.org/" + quote("ö" * 50),
]


def plain_verdict(url, rules):
    _, mark, rest = (url or "").partition("://")
    rest = rest if mark else ""
    for stop in "?#":
        rest = rest.partition(stop)[0]
    host, slash, path = rest.partition("/")
    host, path = host.translate(LOWER), slash + path
    fits = [
        (len(r), len(r.partition("/")[0]), v == "block", r, v)
        for r, v in rules
        if (host == (h := r.partition("/")[0]) or host.endswith("." + h)) and path.startswith(r[len(h) :])
    ]
    best = max(fits, default=(0, 0, False, None, "allow"))
    return host, path, best[3], best[4]


@pytest.mark.parametrize("per_trie", [2, 1000])
def test_url_rules(spark, per_trie):
    rng = random.Random(1)
    hosts = ["org", "example.org", "a.example.org", "com", "x.com", "b.x.com"]
    more = [(rng.choice(hosts) + rng.choice(["", "/", "/a", "/a/", "/a/b", "/ab"]), rng.choice(["allow", "block"])) for _ in range(40)]
    addresses = URLS + [f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/a', '/abc', '/a/b/c', '/a/bc'])}" for _ in range(100)]
    pages = spark.createDataFrame([(i, u, u) for i, u in enumerate(addresses)] + [(None, "http://x.org/", None)], "page_id bigint, url string, verdict string")
    for rules in (URL_RULES, more):
        for r in urls.filter_urls(pages, rules, max_trie_rules=per_trie).collect():
            url = addresses[r.page_id] if r.page_id is not None else "http://x.org/"
            assert (r.host, r.path, r.rule, r.verdict) == plain_verdict(url, rules), url
    assert urls.filter_urls(pages.limit(0), URL_RULES).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href=/>Home</a><li><a href=/x>More</a></ul></nav>
<div class="cookie-notice"><p>We use cookies, as all do, to make this site work, and so on.</p></div>
%s
<aside><p>Related, and also liked, by many, many people all over</p></aside>
<div id="comments"><p>First, great post, thanks, really, a lot, of, commas</p></div>
<form><p>Sign up, now, please</p><input name=q></form><footer>&copy; us</footer></body></html>"""


def test_main_text():
    body = "<article><h2>Head</h2><p>One &amp; two,<b>three</b>\n four&nbsp;five<br>six<p>Seven <script>no()</script>eight</article>"
    assert html.main_text(PAGE % body) == "Head One & two,three four five six Seven eight"
    divs = "<div class=content><p>Long text, with commas, in a paragraph of the page.</p><p>Short</p><!-- x --></div>"
    assert html.main_text(PAGE % divs) == "Long text, with commas, in a paragraph of the page. Short"
    links = "<article><p>Text of some length, here, for all to read.</p><ul>" + "<li><a href=y>Link text</a></li>" * 4 + "</ul></article>"
    assert html.main_text(PAGE % links) == "Text of some length, here, for all to read."
    assert html.main_text(None) == html.main_text("") == html.main_text("<p><script>x</script>") == ""
    assert html.main_text("a < b <p>c") == "a < b c"
    assert html.main_text("<div>" * 20_000 + "deep") == "deep"
    assert html.main_text((PAGE % body)[:500]).startswith("Head")


def test_pages(spark):
    rows = [(1, "u", PAGE % "<article><p>x</p></article>", "t"), (2, None, None, "t"), (None, "u", "", "t"), (1, "u", "<p>é\U0001f600</p>", "t")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in html.extract_text(pages).collect())
    assert got == [(0, "", 0), (1, "x", 1), (1, "é\U0001f600", 2), (2, "", 0)]
    assert html.extract_text(pages.limit(0)).count() == 0


def test_whole_texts_go_to_python_in_small_batches(spark, monkeypatch):
    """A batch is held whole by the executor and by Python, next to what earlier stages left there."""
    name, rows = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before, written = spark.conf.get(name), ngram_join.written
    monkeypatch.setattr(ngram_join, "written", lambda df, label: rows.append(int(spark.conf.get(name))) or written(df, label))
    found = ngram_join.ngram_components(documents(spark, ["a b c d e f", "a b c d e f", "g"]))
    assert rows and max(rows) <= ngram_join.ROWS_PER_BATCH and spark.conf.get(name) == before
    assert sorted(r.component_id for r in found.collect()) == [0, 0, 2]


def test_stages_of_the_pipeline_hold_few_texts_at_once(spark):
    """Stages give tables that run later, next to what earlier stages left in the same executors and workers."""
    docs = spark.range(2000).selectExpr("id AS doc_id", "repeat('ab ', 3000) AS text", "'s' AS source", "'en' AS lang", "9000L AS n_chars")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["bytes"])

    before = {name: spark.conf.get(name) for name in SMALL_BATCHES}
    arrow, reader = SMALL_BATCHES
    stages = dict(corpus_pipeline.STAGES)
    try:
        stages["secret_scan"](spark, docs, "")
        most = docs.coalesce(1).mapInArrow(sizes, "bytes bigint").agg({"bytes": "max"}).first()[0]
        assert most <= SMALL_BATCHES[arrow] * 1.1 and int(spark.conf.get(reader)) <= SMALL_BATCHES[reader]
        spark.conf.set(arrow, "1m")
        spark.conf.set(reader, 100)
        stages["byte_bpe"](spark, docs, "")
        assert spark.conf.get(arrow) in ("1m", str(1 << 20), f"{1 << 20}b") and spark.conf.get(reader) == "100"
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def plain_components(texts):
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both) and sets[j]:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def near_copies(seed, groups=12, copies=8):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = []
    for g in range(groups):
        size = rng.choice([3, 5, 6, 9, 20, 60, 200, 400])
        base = [rng.choice(vocabulary) for _ in range(size)]
        if g % 3 == 0:
            base += passage
        for _ in range(copies):
            words = base[:]
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words[: len(words) - rng.choice([0, 0, 1, 3])]).title() if rng.random() < 0.2 else " ".join(words))
    # a chain whose ends are not linked themselves
    chain = [f"c{i}" for i in range(60)]
    texts += [" ".join(chain[i : i + 40]) for i in range(0, 12, 2)]
    rng.shuffle(texts)
    return texts + [None, "", " \t", "a b", "A  B", "a b c d e", "a b c d e a b c d e"]


@pytest.mark.parametrize("batch,most", [(3, 1000), (5, 4), (50, 2), (1, 3)])
def test_shingles_of_several_components(monkeypatch, batch, most):
    """Groups over many batches; those of too many rows count as shared as a whole."""
    monkeypatch.setattr(ngram_join, "CARRIED", most)
    rng = random.Random(batch)
    rows = sorted((h, key, rng.choice([7, key])) for h in range(40) for key in rng.sample(range(100), rng.choice([1, 1, 2, 5, 9])))
    columns = [pa.array([x << 6 for x in c] if i == 0 else c, pa.int64()) for i, c in enumerate(zip(*rows, strict=True))]
    parts = [pa.RecordBatch.from_arrays([c[i : i + batch] for c in columns], ["h", "key", "root"]) for i in range(0, len(rows), batch)]
    got = sorted(zip(*(sum((b.column(c).to_pylist() for b in out), []) for c in ("ranked", "key")), strict=True)) if (out := list(ngram_join._foreign(iter(parts)))) else []
    groups = defaultdict(list)
    for h, key, root in rows:
        groups[h].append((key, root))
    for h, members in groups.items():
        own = [(ranked >> 58, k) for ranked, k in got if ranked & (1 << 58) - 1 == h]
        assert sorted(k for _, k in own) == (sorted(k for k, _ in members) if own else [])
        shared = len({r for _, r in members}) > 1
        assert len({power for power, _ in own}) <= 1 and (own or not shared)
        if len(members) <= most:
            assert bool(own) == shared and all(power == len(members).bit_length() for power, _ in own)


@pytest.mark.parametrize("seed,common", [(1, 4096), (2, 4096), (3, 30)])
def test_components_are_exact(spark, seed, common, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT_KEYS", common)
    monkeypatch.setattr(ngram_join, "HOT_SAMPLE", 16 if common == 4096 else 1)
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    monkeypatch.setattr(ngram_join, "PIVOTS", 1)
    monkeypatch.setattr(ngram_join, "FIRST_SHINGLES", 1)
    texts = near_copies(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == plain_components(texts)


@pytest.mark.parametrize("hot", [1, 4096])
def test_common_shingles_are_not_rows(spark, monkeypatch, hot):
    """A shingle of many sets is found in each set's own array: no join makes a row for each set that has it."""
    monkeypatch.setattr(ngram_join, "HOT_KEYS", hot)
    monkeypatch.setattr(ngram_join, "HOT_SAMPLE", 1)
    rng = random.Random(hot)
    shift = 64 - ngram_join.SHORT_BITS
    pool = [rng.randrange(-(1 << 47), 1 << 47) << shift for _ in range(50)]
    # two of the second set agree in the bits that are looked at
    made = [sorted(rng.sample(pool, 20), key=lambda h: h % (1 << 64)) for _ in range(40)] + [[pool[0], pool[0] + 1, pool[1]], [5]]
    made[-2].sort(key=lambda h: h % (1 << 64))
    sets = spark.createDataFrame([(i, len(h), h, [i]) for i, h in enumerate(made)], "key bigint, n bigint, shingles array<bigint>, signature array<bigint>")
    roots = spark.createDataFrame([(i, 0) for i in range(10)], "key bigint, root bigint")
    prefixes = ngram_join._prefixes(sets, roots)
    plan = prefixes._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join Inner" in line and "(h#" in line]

    root = [0 if i < 10 else i for i in range(len(made))]
    short = [[h >> shift << shift for h in s] for s in made]
    rows = [h for s in short for h in s]
    of = {h: {root[i] for i, s in enumerate(short) if h in s} for h in set(rows)}
    common = {h for h in of if rows.count(h) * hot > len(rows) and rows.count(h) > 1}
    assert bool(common) == (hot > 1)
    want = {}
    for i, s in enumerate(short):
        rank = {h: 31 if h in common else rows.count(h).bit_length() for h in s if h in common or len(of[h]) > 1}
        order = sorted(rank[h] << 58 | h % (1 << 64) >> 6 for h in s if h in rank)
        if (wanted := len(s) // 5 + 1 - (len(s) - len(order))) > 0:
            want[i] = (len(s), root[i], [i], order[:wanted])
    assert {r.key: (r.n, r.root, r.signature, r.prefix) for r in prefixes.collect()} == want


def test_components_awkward_rows(spark):
    rows = ngram_join.ngram_components(awkward(spark)).collect()
    assert len(rows) == 10
    assert {r.component_id for r in rows if r.doc_id in (1, 2)} == {1}
    assert all(r.component_id == r.doc_id and r.n_shingles == 0 for r in rows if r.doc_id in (3, 4, 5))
    kept = ngram_join.one_of_each(awkward(spark))
    assert kept.columns == awkward(spark).columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 3, 4, 5, 6, 7]
    assert ngram_join.ngram_components(empty(spark)).count() == 0
    assert ngram_join.one_of_each(empty(spark)).count() == 0


def vectors(spark, x, extra=()):
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    return spark.createDataFrame([*rows, *extra], "vec_id bigint, embedding array<float>, label int")


BAD = [(10_000, None, 0), (10_020, [float("nan")] * 8, 0), (10_040, [float("inf")] + [0.0] * 7, 0), (10_060, [None] + [1.0] * 7, None), (None, [1.0] * 8, 0)]


def test_exact_top_k(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "QUERY_BLOCK", 7)
    monkeypatch.setattr(exact_topk, "ROW_BLOCK", 100)
    x = np.random.default_rng(3).standard_normal((700, 8)).astype(np.float32)
    x[100:300] = x[50]
    table = vectors(spark, x, BAD).withColumn("query_id", exact_topk.F.lit(1)).withColumn("score", exact_topk.F.lit("x"))
    got = defaultdict(list)
    for r in exact_topk.search_scaled(table, 5, table["vec_id"] % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    whole = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    assert sorted(got) == list(range(0, 700, 20))
    for q, found in got.items():
        s = whole @ whole[q]
        order = [i for i in np.lexsort((np.arange(700), -s)) if i != q][:5]
        assert found == [(k + 1, i, s[i]) for k, i in enumerate(order)]
    assert exact_topk.search_scaled(table.limit(0), 5, table["vec_id"] % 20 == 0).count() == 0
    few = vectors(spark, x[:3])
    assert exact_topk.search_scaled(few, 5, few["vec_id"] == 0).count() == 2


def test_exact_top_k_beyond_doubles(spark):
    rng = np.random.default_rng(5)
    # large components that differ in the last places only, so that products in double precision would tie
    x = (1_000_000 + rng.integers(-3, 4, (300, 8)) / 256).astype(np.float64) * rng.choice([-1, 1], (1, 8))
    table = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = defaultdict(list)
    for r in exact_topk.search_scaled(table, 5, table["vec_id"] % 50 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    whole = [[int(v) for v in r] for r in np.floor(256 * x)]
    assert sorted(got) == list(range(0, 300, 50))
    for q, found in got.items():
        scores = sorted((-sum(a * b for a, b in zip(r, whole[q], strict=True)), i) for i, r in enumerate(whole) if i != q)
        assert found == [(i, -s) for s, i in scores[:5]]


@pytest.mark.parametrize("large", [1e30, 1e7])
def test_exact_top_k_refuses_products_beyond_longs(spark, large):
    table = spark.createDataFrame([(i, [float(i), large if i == 7 else 1.0]) for i in range(30)], "vec_id bigint, embedding array<double>")
    with pytest.raises(ValueError, match="too large"):
        exact_topk.search_scaled(table, 3, table["vec_id"] % 7 == 0).collect()


def test_neighbour_search_recall(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((30, 8))
    x = (centres[rng.integers(0, 30, 2500)] + 0.5 * rng.standard_normal((2500, 8))).astype(np.float32)
    x[200:400] = x[40]
    x[7] = 0
    table = vectors(spark, x, BAD).withColumn("rank", ann.F.lit("r")).withColumn("node", ann.F.lit(2))
    got = defaultdict(list)
    for r in ann.search_neighbours(table, 20, table["vec_id"] % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    s = x.astype(np.float64) @ x.astype(np.float64).T
    hit = 0
    assert sorted(got) == list(range(0, 2500, 20))
    for q, found in got.items():
        assert len(found) == 20 and q not in dict(found) and 7 not in dict(found)
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
        assert all(f[1] == pytest.approx(s[q, f[0]], abs=1e-12) for f in found)
        order = [i for i in np.lexsort((np.arange(2500), -s[q])) if i not in (q, 7)][:20]
        hit += len(set(order) & set(dict(found)))
    assert hit / (20 * len(got)) >= 0.9
    assert ann.search_neighbours(table.limit(0), 20, table["vec_id"] % 20 == 0).count() == 0
    few = vectors(spark, x[:4])
    assert ann.search_neighbours(few, 20, few["vec_id"] == 0).count() == 3


def test_sharding_runs_no_python(spark):
    plan = sharding.shard_documents(awkward(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "MapIn"))


def dense_tables():
    """A third of all vectors in one tight cluster; all vectors about one mean direction."""
    rng = np.random.default_rng(8)
    cluster = rng.standard_normal((6000, 16)).astype(np.float32)
    cluster[:2000] = 3 * rng.standard_normal(16) + 0.05 * rng.standard_normal((2000, 16))
    return {"cluster": cluster, "mean": (8 + rng.standard_normal((6000, 16))).astype(np.float32)}


def recall(spark, x, k=10, step=60):
    table = vectors(spark, x)
    got = defaultdict(set)
    for r in ann.search_neighbours(table, k, table["vec_id"] % step == 0).collect():
        got[r.query_id].add(r.vec_id)
    hit = 0
    for q in range(0, len(x), step):
        s = x.astype(np.float64) @ x[q].astype(np.float64)
        hit += len(got[q] & set([i for i in np.lexsort((np.arange(len(x)), -s)) if i != q][:k]))
    return hit / (k * len(range(0, len(x), step)))


def test_dense_leaves_are_split_by_place(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAF", 64)
    monkeypatch.setattr(ann, "SPLITS", 3)
    x = dense_tables()["mean"]
    nodes = ann.written(ann._nodes(vectors(spark, x).selectExpr("vec_id id", "transform(embedding, x -> cast(x as double)) v"), 2), "t")
    coded = ann.written(ann._coded(nodes, 16), "t")
    leaves = defaultdict(list)
    for r in ann._leaves(coded, len(x), 16).select("node", "leaf").collect():
        leaves[r.leaf].append(r.node)
    assert sorted(i for v in leaves.values() for i in v) == sorted(list(range(len(x))) * ann.PARTITIONINGS)
    assert max(map(len, leaves.values())) <= 128
    # nodes of a leaf are nearer to each other than any two rows are
    spread = np.mean([x[v].std(axis=0).mean() for v in leaves.values()])
    assert spread < 0.9 * x.std(axis=0).mean()


def test_neighbours_in_a_tight_cluster(spark):
    """Queries of the cluster alone, which an average over all would hide: a third of 12,000 rows, k of 20."""
    rng = np.random.default_rng(12)
    x = rng.standard_normal((12_000, 32)).astype(np.float32)
    x[:4000] = 3 * rng.standard_normal(32) + 0.05 * rng.standard_normal((4000, 32))
    table = vectors(spark, x)
    got = defaultdict(set)
    for r in ann.search_neighbours(table, 20, table["vec_id"] % 200 == 0).collect():
        got[r.query_id].add(r.vec_id)
    shares = {}
    for part, queries in (("cluster", range(0, 4000, 200)), ("others", range(4000, 12_000, 200))):
        hit = 0
        for q in queries:
            s = x.astype(np.float64) @ x[q].astype(np.float64)
            hit += len(got[q] & set([i for i in np.lexsort((np.arange(len(x)), -s)) if i != q][:20]))
        shares[part] = hit / (20 * len(queries))
    print(shares)
    assert min(shares.values()) >= 0.9


@pytest.mark.parametrize("size", [1e200, 1e-320])
def test_products_beyond_doubles_are_refused(spark, size):
    table = spark.createDataFrame([(i, [size, size]) for i in range(30)], "vec_id bigint, embedding array<double>")
    with pytest.raises(ValueError, match="range of doubles"):
        ann.search_neighbours(table, 3, table["vec_id"] % 10 == 0)


def test_neighbours_beside_a_very_large_row(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1500, 16))
    x = (0.5 * x / np.abs(x).max(axis=1, keepdims=True)).astype(np.float32)
    x[11] = 0
    x[11, 0] = 100
    assert recall(spark, x) >= 0.9


def test_main_text_keeps_articles_in_doubtful_elements():
    p = "<p>Text of some length, here, for all to read, with commas.</p>"
    plain = "Text of some length, here, for all to read, with commas."
    for shell in (
        "<div class='layout has-sidebar'>%s</div>",
        "<article class='post comments-open'>%s</article>",
        "<div id='page' class='nav-fixed'><div>%s</div></div>",
        "<form action=x>%s</form>",
    ):
        assert html.main_text(PAGE % (shell % (p * 3))) == " ".join([plain] * 3), shell
    beside = f"<div>{p * 3}</div><div class=sidebar><p>Other things.</p></div><form>Log in</form>"
    assert html.main_text(PAGE % beside) == " ".join([plain] * 3)
    names = "<p>" + ", ".join(f"<a href=y>Name {i}</a>" for i in range(5)) + "</p>"
    sources = "<ul>" + "".join(f"<li><a href=y>A source with a long title, {i}</a></li>" for i in range(3)) + "</ul>"
    got = html.main_text(PAGE % f"<article>{p * 3}{names}{sources}</article>")
    assert "Name 4" in got and "long title, 2" in got
    assert "Short part" in html.main_text(PAGE % f"<div>{p}</div><div>Short part, of the text, here.</div>")


def test_mix_meets_targets_of_tiny_sources(spark):
    sources = [f"t{i:02}" for i in range(20)] + ["z"] * 30
    texts = ["w " * (4 + i % 7) for i in range(20)] + ["w " * 50] * 30
    taken, want = defaultdict(int), {}
    for r in mixing.mix_sources(documents(spark, texts, sources)).collect():
        taken[r.source] += r.taken
        want[r.source] = r.target
    for s, t in want.items():
        assert abs(taken[s] - t) <= 1, s


def test_pipeline_mix_emits_the_words_of_long_documents(spark):
    import corpus_pipeline

    # documents longer than a shard in a source that gets less than half of its words; a source of one document
    sources = ["a"] * 11 + ["b"] * 300 + ["c"] * 300 + [None]
    texts = ["w " * (60_000 + 10 * i) for i in range(11)] + ["w " * (1000 + i % 60) for i in range(600)] + ["w " * 700]
    docs = documents(spark, texts, sources)
    want = {r.source: r.target for r in mixing.mix_sources(docs).collect()}
    assert want["a"] < 0.5 * sum(len(t) // 2 for t in texts[:11])
    got = defaultdict(int)
    for r in corpus_pipeline.mix(spark, docs, "").select("source", "text").collect():
        got[r.source] += len(r.text.split())
    assert set(got) == set(want)
    for s, t in want.items():
        assert abs(got[s] - t) <= {"a": 30_100}.get(s, 1060), s
    assert mixing.whole_copies([(0, 0, 10, 3)], False) == [(0, 0, 1)]


LONG = "<p>Text of some length, here, for all to read, with commas.</p>"
PLAIN = "Text of some length, here, for all to read, with commas."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<div><section>{LONG * 4}</section><section><p>Short end.</p></section></div>", f"{' '.join([PLAIN] * 4)} Short end."),
        (f"<div id=all><div>{LONG * 4}</div><div>Closing line.</div></div>", f"{' '.join([PLAIN] * 4)} Closing line."),
        (f"<div><div><div>{LONG * 4}</div></div><div><div><p>Second one.</p></div></div></div>", f"{' '.join([PLAIN] * 4)} Second one."),
        (f"<div><div><div>{LONG * 4}</div><div>A line.</div></div><div>{LONG * 2}</div></div>", f"{' '.join([PLAIN] * 4)} A line. {PLAIN} {PLAIN}"),
        (f"<div><div>{LONG * 4}</div><div><a href=x>Go on.</a></div><div>No more</div></div>", " ".join([PLAIN] * 4)),
    ],
)
def test_main_text_keeps_short_parts(page, text):
    assert html.main_text(PAGE % page) == text


def test_main_text_keeps_paragraphs_named_like_page_parts():
    inside = "<p class=tags-explained>What tags are.</p><div class=social-history><p>How people met.</p></div>"
    assert html.main_text(PAGE % f"<article>{LONG * 3}{inside}</article>") == f"{' '.join([PLAIN] * 3)} What tags are. How people met."
    parts = "<div class=ad-slot>Buy this.</div><p class=ad>Buy that.</p><div class='social-links-2'><a href=x>Like it.</a></div><div class=share>Tell all</div>"
    parts += "<section class=post-comments-x><p>Nice, thanks.</p></section>"
    assert html.main_text(PAGE % f"<article>{LONG * 3}{parts}</article>") == " ".join([PLAIN] * 3)


@pytest.mark.parametrize(
    "comments",
    [
        "<section id=discussion><h3>3 replies</h3><div>Well said, I think.</div><div>No, not at all.</div></section>",
        "<h3>Comments (2)</h3><div>Well said, I think.</div><div>No, not at all.</div>",
        "<div><div><b>Ann</b> <time>2 hours ago</time><p>Well said, I think.</p></div><div><b>Bob</b> <i>May 3, 2021</i><p>No.</p></div></div>",
        "<ul><li><span>Ann, 2021-04-05</span><p>Well said.</p></li><li><span>Bob, 2021-04-06</span><p>Not at all.</p></li></ul>",
    ],
)
@pytest.mark.parametrize("shell", ["<article>%s</article>", "<div>%s</div>"])
def test_main_text_without_comments(comments, shell):
    assert html.main_text(PAGE % (shell % (LONG * 4 + comments))) == " ".join([PLAIN] * 4)


def test_main_text_of_dates_and_discussions():
    dated = "<h2>Discussion</h2><ul><li>On May 3, 2021 the first results came in.</li><li>On May 4, 2021 all was repeated.</li></ul>"
    got = html.main_text(PAGE % f"<article>{LONG * 3}{dated}</article>")
    assert got.endswith("Discussion On May 3, 2021 the first results came in. On May 4, 2021 all was repeated.")


def test_main_text_of_very_long_pages():
    assert html.main_text(PAGE % f"<article>{LONG * 20_000}</article>") == " ".join([PLAIN] * 20_000)
    assert html.main_text("<div><h3>2 replies</h3>" * 5000 + LONG * 5000).endswith(PLAIN)
