"""URL filters: a broadcast trie over reversed host labels and path segments."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_TRIE_RULES = 200_000
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Trie:
    """Rules by reversed host label, then by whole path segment, then by the begin of the last segment.

    A node is ``[labels, paths]``, a path node ``[segments, tails]``; ``tails`` maps the begin of a
    segment to a rule, and the tail ``None`` of the first path node is a rule without a path.
    """

    def __init__(self, rules: Iterable[tuple[str, str]]):
        self.root: list = [{}, None]
        for rule, verdict in rules:
            host, slash, path = rule.partition("/")
            node = self.root
            for label in reversed(host.translate(_LOWER).split(".")):
                node = node[0].setdefault(label, [{}, None])
            if node[1] is None:
                node[1] = [{}, {}]
            at = node[1]
            *whole, tail = path.split("/")
            for segment in whole:
                at = at[0].setdefault(segment, [{}, {}])
            key = tail if slash else None
            # of the same rule for both verdicts, block stands
            if at[1].get(key, ("", ""))[1] != "block":
                at[1][key] = (rule, verdict)

    def hosts(self, host: str) -> list[list]:
        """Path nodes of all rules whose host is ``host`` or a parent of it."""
        found, node = [], self.root
        for label in reversed(host.split(".")):
            node = node[0].get(label)
            if node is None:
                break
            if node[1] is not None:
                found.append(node[1])
        return found

    @staticmethod
    def best(nodes: list[list], path: str) -> tuple[str, str] | None:
        """The longest rule below ``nodes`` with which ``path`` begins; of equals that of the longer host."""
        found: tuple[str, str] | None = None
        for at in nodes:
            hits = [at[1][None]] if None in at[1] else []
            if path.startswith("/"):
                for segment in path[1:].split("/"):
                    hits += [at[1][segment[:n]] for n in {len(t) for t in at[1] if t is not None} if segment[:n] in at[1]]
                    at = at[0].get(segment)
                    if at is None:
                        break
            for hit in hits:
                if found is None or len(hit[0]) >= len(found[0]):
                    found = hit
        return found


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path; without ``://`` both are empty."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for i in (rest.find("?"), rest.find("#")) if i >= 0), default=len(rest))
    host, slash, path = rest[:end].partition("/")
    return host.translate(_LOWER), slash + path


def filter_urls(
    pages: DataFrame,
    rules: list[tuple[str, str]],
    page_id: str = "page_id",
    url: str = "url",
    default: str = "allow",
    max_trie_rules: int = MAX_TRIE_RULES,
) -> DataFrame:
    """Judges every url by its longest matching rule.

    ``rules`` are pairs of ``host/path`` and ``allow`` or ``block``. A rule fits its host and all
    subdomains if the path of the url begins with the rule's path. The longest rule string wins; of two
    of the same length that of the longer host, of the same rule twice ``block``. Rules are broadcast in
    tries of at most ``max_trie_rules`` each; more rules make more passes over the rows, not larger
    tries.

    Returns ``page_id``, ``host``, ``path``, ``rule`` (null if none fits) and ``verdict`` (then
    ``default``), one row per row of ``pages``. Null urls and those without ``://`` have an empty host and
    path and fit no rule. Repeated rows stay; an empty table gives no rows; other columns are not read.
    """
    out = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    out = out.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    kind = pages.schema[page_id].dataType.simpleString()
    for first in range(0, max(len(rules), 1), max_trie_rules):
        shared = pages.sparkSession.sparkContext.broadcast(Trie(rules[first : first + max_trie_rules]))

        def judge(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            trie, nodes = shared.value, {}
            for batch in batches:
                hosts, paths, found, verdicts = [], [], [], []
                for u, rule, verdict in zip(*(batch.column(c).to_pylist() for c in ("url", "rule", "verdict")), strict=True):
                    host, path = split_url(u)
                    if host not in nodes:
                        if len(nodes) > 50_000:
                            nodes.clear()
                        nodes[host] = trie.hosts(host)
                    best = trie.best(nodes[host], path) if nodes[host] else None
                    better = best is not None and (rule is None or _rank(best) > _rank((rule, verdict)))
                    hosts.append(host)
                    paths.append(path)
                    found.append(best[0] if better else rule)
                    verdicts.append(best[1] if better else verdict)
                columns = [batch.column("page_id"), batch.column("url"), *(pa.array(x, pa.string()) for x in (hosts, paths, found, verdicts))]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "host", "path", "rule", "verdict"])

        out = out.select("page_id", "url", "rule", "verdict").mapInArrow(
            judge, f"page_id {kind}, url string, host string, path string, rule string, verdict string"
        )
    return out.select("page_id", "host", "path", "rule", "verdict")


def _rank(rule: tuple[str, str]) -> tuple[int, int, bool]:
    return len(rule[0]), len(rule[0].partition("/")[0]), rule[1] == "block"
