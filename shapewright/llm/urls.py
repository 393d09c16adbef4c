"""URL filters: a trie over reversed host labels and path segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rules at most: the trie is broadcast, so its size is bounded; more need another blocklist format.
MOST_RULES = 1_000_000

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: The verdict on an url that no rule fits.
DEFAULT = "allow"


class Trie:
    """Rules by reversed host labels, then by whole path segments.

    A rule's last segment may be a beginning only (``/en`` fits ``/english``):
    such beginnings are kept at the node of the segments before it. Longest
    match: more host labels first, then the longer path."""

    def __init__(self, rules):
        self.root: dict = {}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.lower().split(".") if host else []):
                node = node.setdefault(label, {})
            node = node.setdefault(None, {})  # None: the path trie of this host
            *whole, last = path.split("/")
            for segment in whole:
                node = node.setdefault(segment, {})
            own = node.setdefault(None, {})  # None: beginnings of the next segment
            before = own.get(last)
            rule = (verdict, f"{host}{path}")
            own[last] = rule if before is None or rule < before else before  # a tie: allow before block

    def find(self, host: str, path: str):
        """(verdict, rule) or None."""
        node, best = self.root, self._path(self.root.get(None), path)
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            best = self._path(node.get(None), path) or best
        return best

    @staticmethod
    def _path(node, path: str):
        best = None
        segments = path.split("/")
        for segment in segments:
            if node is None:
                break
            for start, rule in sorted((node.get(None) or {}).items(), key=lambda x: len(x[0])):
                if segment.startswith(start):
                    best = rule
            node = node.get(segment)
        return best


def judge(pages: DataFrame, rules=None, default: str = DEFAULT) -> DataFrame:
    """Per row of ``pages(page_id, url)``: page_id, host, path, rule, verdict.

    Null urls and urls without ``://`` have an empty host and path and, unless a
    rule fits these, the default verdict and a null rule. Null and repeated
    page_ids give a row each; other columns aren't read."""
    rules = RULES if rules is None else list(rules)
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; the broadcast trie holds {MOST_RULES}")
    trie = Trie(rules)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [trie.find(h, p) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            rule = pa.array([f[1] if f else None for f in found], pa.string())
            verdict = pa.array([f[0] if f else default for f in found], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, rule, verdict], names=[*batch.schema.names, "rule", "verdict"])

    url = F.coalesce("url", F.lit(""))
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    kind = dict(pages.dtypes)["page_id"]
    return pages.select("page_id", host.alias("host"), path.alias("path")).mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")
