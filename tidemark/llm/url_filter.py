"""URL filtering: rules indexed by their rarest literal token."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class Rule:
    """``text`` is host and path prefix, as in ``example.net/en/``; it fits the host and its subdomains."""

    text: str
    verdict: str

    @property
    def pattern(self) -> str:
        host, slash, path = self.text.partition("/")
        return rf"(?:[^/]*\.)?{re.escape(host.lower())}{re.escape(slash + path)}"

    @property
    def tokens(self) -> set[str]:
        """Literals that every URL the rule fits has as whole tokens: the host's labels, and the
        path's parts that the prefix closes."""
        host, slash, path = self.text.partition("/")
        whole = path if not re.search(r"[A-Za-z0-9]$", path) else re.sub(r"[A-Za-z0-9]+$", "", path)
        return set(TOKEN.findall(host.lower())) | set(TOKEN.findall((slash + whole).lower()))


def split_url(url: str | None) -> tuple[str, str]:
    if not url or "://" not in url:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def url_tokens(host: str, path: str) -> set[str]:
    return set(TOKEN.findall(f"{host}{path}".lower()))


def token_counts(pages: DataFrame, tokens: Iterable[str], url_col: str = "url") -> dict[str, int]:
    """In how many rows each of the rules' tokens occurs: one row a token reaches the driver."""
    wanted = sorted(set(tokens))
    found = (
        pages.select(F.explode(F.array_intersect(F.array_distinct(F.split(F.lower(url_col), "[^a-z0-9]+")), F.array(*map(F.lit, wanted)))).alias("t"))
        .groupBy("t")
        .count()
    )
    return {t: 0 for t in wanted} | {r["t"]: r["count"] for r in found.collect()}


def build_index(rules: list[Rule], counts: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """Token to the rules filed under it, and the rules without a literal token."""
    index: dict[str, list[int]] = {}
    rest = []
    for k, rule in enumerate(rules):
        if rule.tokens:
            index.setdefault(min(sorted(rule.tokens), key=lambda t: counts.get(t, 0)), []).append(k)
        else:
            rest.append(k)
    return index, rest


def judge_urls(pages: DataFrame, rules: list[Rule], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: id, host, path, the longest rule that fits, and its verdict.

    The rules are the caller's list, so its size is known on the driver; the index that is sent to
    the tasks is as large as that list. A rule is filed under the one of its literal tokens that
    fewest URLs have. A URL's tokens fetch the rules filed under them, and only their regular
    expressions run. Of fitting rules the longest wins, of equally long ones the first of the
    list. No rule: ``rule`` is null and the verdict is ``default``. Null or malformed URLs have
    empty host and path; URLs are read whole, however long. Ids are handed on as they are, null ones
    and the largest too. No row is moved, so repeated rows and hot hosts cost nothing more. Other
    columns are not read, and an empty table gives no rows.
    """
    rules = list(rules)
    counts = token_counts(pages, [t for r in rules for t in r.tokens], url_col) if rules else {}
    index, rest = build_index(rules, counts)
    sources = [r.pattern for r in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [re.compile(x) for x in sources]
        for batch in batches:
            out = []
            for url in batch.column("url").to_pylist():
                host, path = split_url(url)
                asked = {k for t in url_tokens(host, path) for k in index.get(t, ())}
                fits = [k for k in (*asked, *rest) if host and compiled[k].match(host + path)]
                best = min(fits, key=lambda k: (-len(rules[k].text), k), default=None)
                out.append((host, path, None if best is None else rules[best].text, default if best is None else rules[best].verdict))
            told = [pa.array(c, pa.string()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.string())] * 4
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), *told], names=["page_id", "host", "path", "rule", "verdict"])

    asked = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"))
    judged = asked.mapInArrow(run, "page_id bigint, host string, path string, rule string, verdict string")
    return judged.withColumnRenamed("page_id", id_col)
