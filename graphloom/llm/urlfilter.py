"""URL filter: a trie over reversed host labels, then path segments, with longest-match precedence.

A rule is (verdict, host, path). It fits its host and every subdomain, if the url's path starts with the rule's
path. Of the fitting rules the one with most host labels wins, then the one with the longest path; between equal
rules block wins. The trie's edges are host labels from the right, then whole path segments; the rest of a path
after its last slash ("/en/1") is kept at its segment's node and compared as a prefix.

The rules are broadcast in tries of at most ``MAX_RULES`` rules and ``MAX_RULE_CHARS`` characters; a longer list
goes over the rows in that many blocks, one after another, which carry the best match so far. So each broadcast
has a fixed bound and no rule is lost.

Defined results: a null url or one without ``://`` has an empty host and path and fits no rule (a rule whose host
is empty fits nothing); such rows, like all without a fitting rule, get the default verdict; repeated rows are judged
one by one; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm.common import column, map_batches

MAX_RULES, MAX_RULE_CHARS = 200_000, 16 << 20
Rule = tuple[str, str, str]  # verdict, host, path

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z folded) and path of a url."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((p for c in "/?#" if (p := rest.find(c)) >= 0), default=len(rest))
    host, rest = rest[:end].translate(_LOWER), rest[end:]
    return host, rest[: min((p for c in "?#" if (p := rest.find(c)) >= 0), default=len(rest))]


class Node:
    """A place in the trie. ``rules``: remainder of a path below this node -> (verdict, rule's text, path's length)."""

    __slots__ = ("labels", "segments", "rules")

    def __init__(self) -> None:
        self.labels: dict[str, Node] = {}
        self.segments: dict[str, Node] = {}
        self.rules: dict[str, tuple[str, str, int]] = {}


class UrlTrie:
    def __init__(self, rules: Iterable[Rule]) -> None:
        self.root = Node()
        for verdict, host, path in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"verdict must be allow or block: {verdict}")
            host = host.translate(_LOWER)
            if not host:
                continue
            node = self.root
            for label in reversed(host.split(".")):
                node = node.labels.setdefault(label, Node())
            *segments, last = path.split("/")
            for segment in segments:
                node = node.segments.setdefault(segment, Node())
            held = node.rules.get(last)
            if held is None or (held[0], verdict) == ("allow", "block"):
                node.rules[last] = (verdict, host + path, len(path))

    def match(self, host: str, path: str) -> tuple[int, int, str, str] | None:
        """(host labels, path length, verdict, rule) of the winning rule."""
        best, node, depth = None, self.root, 0
        if not host:
            return None
        for label in reversed(host.split(".")):
            node = node.labels.get(label)
            if node is None:
                break
            depth += 1
            if found := self._longest(node, path):
                best = (depth, found[2], found[0], found[1])  # deeper in the host always wins
        return best

    @staticmethod
    def _longest(node: Node, path: str) -> tuple[str, str, int] | None:
        best, at = None, 0
        while True:
            if node.rules:
                end = path.find("/", at)
                rest = path[at:] if end < 0 else path[at:end]  # a remainder holds no slash
                for size in range(len(rest) if len(rest) < 256 or len(node.rules) > len(rest) else 0, -1, -1):
                    if (found := node.rules.get(rest[:size])) is not None:
                        best = found
                        break
                if len(rest) >= 256 and len(node.rules) <= len(rest):  # few rules, long segment: try the rules
                    fits = [(len(k), v) for k, v in node.rules.items() if rest.startswith(k)]
                    best = max(fits, default=(0, best), key=lambda x: x[0])[1]
            end = path.find("/", at)
            if end < 0 or (node := node.segments.get(path[at:end])) is None:
                return best
            at = end + 1


def _blocks(rules: list[Rule]) -> list[list[Rule]]:
    out, size = [[]], 0
    for rule in rules:
        size += len(rule[1]) + len(rule[2])
        if out[-1] and (len(out[-1]) >= MAX_RULES or size > MAX_RULE_CHARS):
            out.append([])
            size = len(rule[1]) + len(rule[2])
        out[-1].append(rule)
    return out


#: This worker's trie, by a name that is new for each broadcast.
_tries: dict[str, UrlTrie] = {}


def judge_urls(pages: DataFrame, rules: Iterable[Rule], default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages`` (page_id, url)."""
    sc = pages.sparkSession.sparkContext
    state = pages.select("page_id", "url").selectExpr(
        "page_id", "url", "cast(null as int) labels", "cast(null as int) chars", "cast(null as string) verdict", "cast(null as string) rule"
    )
    schema = "page_id long, url string, labels int, chars int, verdict string, rule string"
    blocks = _blocks(list(rules))
    for k, block in enumerate(blocks):
        shared, key, last = sc.broadcast(block), uuid.uuid4().hex, k == len(blocks) - 1

        def apply(batch: pa.RecordBatch, shared=shared, key=key, last=last) -> pa.RecordBatch:
            if key not in _tries:
                _tries.clear()
                _tries[key] = UrlTrie(shared.value)
            trie, parts, out = _tries[key], [], []
            for url, *best in zip(*(column(batch, n).to_pylist() for n in ("url", "labels", "chars", "verdict", "rule")), strict=True):
                parts.append(split_url(url))
                found = trie.match(*parts[-1])
                if found and (best[0] is None or (found[0], found[1], found[2]) > (best[0], best[1], best[2])):
                    best = list(found)  # "block" sorts after "allow"
                out.append(best)
            if last:
                cols = [[h for h, _ in parts], [p for _, p in parts], [x[3] for x in out], [x[2] or default for x in out]]
                return pa.RecordBatch.from_arrays(
                    [column(batch, "page_id"), *(pa.array(c, pa.string()) for c in cols)], names=["page_id", "host", "path", "rule", "verdict"]
                )
            cols = [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.string(), pa.string()))]
            return pa.RecordBatch.from_arrays(
                [column(batch, "page_id"), column(batch, "url"), *cols], names=["page_id", "url", "labels", "chars", "verdict", "rule"]
            )

        state = map_batches(state, apply, "page_id long, host string, path string, rule string, verdict string" if last else schema)
    return state


#: The rules of the registered query.
QUERY_RULES: list[Rule] = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]

ORACLE_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS rest FROM pages
), parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM cut
), rules(verdict, rhost, rpath) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), matched AS (
  SELECT p.page_id, p.host, p.path, r.verdict, r.rhost || r.rpath AS rule,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rhost) DESC NULLS LAST, length(r.rpath) DESC) AS rn
  FROM parts p LEFT JOIN rules r
    ON (p.host = r.rhost OR p.host LIKE '%.' || r.rhost) AND starts_with(p.path, r.rpath)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM matched WHERE rn = 1
"""
