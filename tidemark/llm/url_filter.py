"""URL filter: a trie over reversed host labels, then over path segments; the part of a segment at a rule's end is a
trie of characters.

A rule is ``host`` + ``path`` (``example.org/es/``), with the verdict allow or
block.  It fits its host and all subdomains, if the URL's path starts with the
rule's path.  The rule with the most host labels wins, then the one with the
longest path; where both lists hold the same rule, block wins.  A URL that no
rule fits gets ``default``.

The host runs from the first ``://`` to ``/``, ``?``, ``#`` or the end, with A-Z
lower-cased; the path goes on from there to ``?``, ``#`` or the end.

Edge cases.  A null URL, or one without ``://``, has an empty host and path and
fits no rule.  Repeated rows and null ids give a row each; other columns are
passed by; an empty table gives an empty result.  The rules are broadcast up to
``MAX_RULES``, and each worker builds the trie once.  Rule tables of any size are for
``url_filter_by_table``, which joins each URL's host suffixes and path prefixes with the rules; its result is the same.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_RULES = 1_000_000
_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_LOWER = {c: c + 32 for c in range(65, 91)}


class _Node:
    __slots__ = ("labels", "paths")

    def __init__(self) -> None:
        self.labels: dict[str, _Node] = {}
        self.paths: _Segment | None = None


class _Segment:
    """``after`` leads on past a whole path segment; ``ends`` is a trie of characters with (rule, verdict) under ""."""

    __slots__ = ("after", "ends")

    def __init__(self) -> None:
        self.after: dict[str, _Segment] = {}
        self.ends: dict = {}


def split_url(url: str | None) -> tuple[str, str]:
    found = _URL.search(url or "")
    return (found[1].translate(_LOWER), found[2]) if found else ("", "")


class UrlTrie:
    def __init__(self, allow: Iterable[str], block: Iterable[str]):
        self.root = _Node()
        verdicts = {rule: "allow" for rule in allow} | {rule: "block" for rule in block}
        if len(verdicts) > MAX_RULES:
            raise ValueError(f"more than {MAX_RULES} rules: use url_filter_by_table")
        for rule, verdict in verdicts.items():
            host, slash, path = rule.partition("/")
            node = self.root
            for label in reversed(host.translate(_LOWER).split(".")):
                node = node.labels.setdefault(label, _Node())
            node.paths = segment = node.paths or _Segment()
            *whole, rest = (slash + path).split("/")
            for part in whole:
                segment = segment.after.setdefault(part, _Segment())
            end = segment.ends
            for character in rest:
                end = end.setdefault(character, {})
            end[""] = (rule, verdict)

    @staticmethod
    def _in_path(segment: _Segment, path: str) -> tuple[str, str] | None:
        best, parts = None, path.split("/")
        for part in parts:
            end = segment.ends
            best = end.get("", best)
            for character in part:
                end = end.get(character)
                if end is None:
                    break
                best = end.get("", best)
            segment = segment.after.get(part)
            if segment is None:
                break
        return best

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the rule that wins, or None."""
        best, node = None, self.root
        for label in reversed(host.split(".")):
            node = node.labels.get(label)
            if node is None:
                break
            if node.paths is not None and (found := self._in_path(node.paths, path)):
                best = found
        return best


@lru_cache(maxsize=2)
def _trie(allow: tuple[str, ...], block: tuple[str, ...]) -> UrlTrie:
    return UrlTrie(allow, block)


def url_filter(pages: DataFrame, *, allow: Iterable[str], block: Iterable[str], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: the id, host, path, rule (null where none fits), verdict."""
    allow, block = tuple(allow), tuple(block)
    if len(allow) + len(block) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules: use url_filter_by_table")
    rules = pages.sparkSession.sparkContext.broadcast((allow, block))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _trie(*rules.value)
        for batch in batches:
            split = [split_url(u) for u in batch.column(1).to_pylist()]
            found = [known.find(*x) for x in split]
            columns = [[h for h, _ in split], [p for _, p in split], [f and f[0] for f in found], [f[1] if f else default for f in found]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in columns)], ["page_id", "host", "path", "rule", "verdict"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    return rows.mapInArrow(judge, "page_id long, host string, path string, rule string, verdict string")


def url_filter_by_table(pages: DataFrame, rules: DataFrame, *, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Like ``url_filter``, with the rules in a table (rule, verdict) of any size.

    Each distinct host and path asks for its host suffixes with its path prefixes of the lengths that rules have; those
    lengths, a few hundred numbers, are all that goes to the driver.
    """
    lower = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    slash = F.instr("rule", "/")
    host = lower(F.when(slash > 0, F.substring("rule", F.lit(1), slash - 1)).otherwise(F.col("rule")))
    known = rules.select("rule", "verdict", host.alias("r_host"), F.when(slash > 0, F.expr("substring(rule, instr(rule, '/'))")).otherwise("").alias("r_path"))
    known = known.groupBy("rule").agg(F.max("verdict").alias("verdict"), F.first("r_host").alias("r_host"), F.first("r_path").alias("r_path"))  # block wins over allow
    lengths = sorted(r["n"] for r in known.select(F.length("r_path").alias("n")).distinct().collect())
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"))
    rows = rows.select("page_id", lower(F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)", 1)).alias("host"), F.regexp_extract("url", r"(?s)^.*?://[^/?#]*([^?#]*)", 1).alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]) if lengths else F.array().cast("array<int>"), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    asked = rows.select("host", "path").distinct().withColumn("r_host", F.explode(suffixes)).withColumn("r_path", F.explode(prefixes))
    order = F.struct(F.size(F.split("r_host", r"\.")), F.length("r_path"))
    best = asked.join(known, ["r_host", "r_path"]).groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), order).alias("best"))
    return rows.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
