"""URL filters: host rules first, then a weighted vocabulary searched with Aho-Corasick."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.base import view


class Term(NamedTuple):
    """A lower-case vocabulary entry; ``strict`` ones reject alone, ``anywhere`` ones need no word boundary."""

    text: str
    weight: float
    strict: bool
    anywhere: bool = False


class HostRule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The rules of the query and a vocabulary for adult, gambling, piracy and spam addresses.
HOST_RULES = (
    HostRule("com", "/", "allow"),
    HostRule("example.com", "/en/", "block"),
    HostRule("www.example.com", "/en/", "allow"),
    HostRule("net", "/es/", "block"),
    HostRule("net", "/fr/", "block"),
)
STRICT = "porn porno xxx hentai milf camgirl camgirls escorts nsfw bestiality warez keygen"
STRICT_ANYWHERE = "pornhub xvideos freeporn sexcam onlinecasino"
SOFT = (
    "sex sexy adult nude naked erotic fetish dating casino poker slots betting jackpot roulette bingo "
    "torrent crack cracked serial nulled viagra cialis pills pharmacy replica payday loans bonus free cheap"
)
VOCABULARY = (
    *(Term(w, 1.0, True) for w in STRICT.split()),
    *(Term(w, 1.0, True, True) for w in STRICT_ANYWHERE.split()),
    *(Term(w, 0.5, False) for w in SOFT.split()),
)
MIN_SOFT = 2


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _automaton(vocabulary: tuple[Term, ...]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for i, term in enumerate(vocabulary):
        found.add_word(term.text, (i, len(term.text)))
    if vocabulary:
        found.make_automaton()
    return found


def _hits(text: str, found: ahocorasick.Automaton, vocabulary: tuple[Term, ...]) -> set[int]:
    """Distinct terms in ``text``; each side must be an end or no letter or digit."""
    hits = set()
    for end, (i, size) in found.iter(text):
        start = end - size + 1
        bounded = (start == 0 or not text[start - 1].isalnum()) and (end + 1 == len(text) or not text[end + 1].isalnum())
        if bounded or vocabulary[i].anywhere:
            hits.add(i)
    return hits


def _rule_index(rules: tuple[HostRule, ...]) -> dict[str, list[HostRule]]:
    index: dict[str, list[HostRule]] = {}
    for rule in sorted(rules, key=lambda r: -len(r.name)):
        index.setdefault(rule.host, []).append(rule)
    return index


def _rule_for(host: str, path: str, index: dict[str, list[HostRule]]) -> HostRule | None:
    """Longest rule for the host or a domain above it whose path starts the url's path."""
    best, at = None, 0
    while True:
        for rule in index.get(host[at:], ()):
            if path.startswith(rule.path):
                if best is None or len(rule.name) > len(best.name):
                    best = rule
                break
        dot = host.find(".", at)
        if dot < 0:
            return best
        at = dot + 1


def judge(
    pages: DataFrame, url_col: str = "url", rules: tuple[HostRule, ...] = HOST_RULES,
    vocabulary: tuple[Term, ...] = VOCABULARY, min_soft: int = MIN_SOFT,
) -> DataFrame:
    """``pages`` plus a struct ``_url``: host, path, rule, strict, soft, score, verdict.

    A host rule decides where one fits, the longest first. Else a url is blocked
    if it has one strict term or ``min_soft`` distinct soft ones; ``score`` sums the
    weights of its distinct terms. The whole url is searched, in lower case. Null
    urls have an empty host and path, no rule, no hits and verdict allow. Rows
    are judged one by one in Arrow batches, without a shuffle; rules and
    vocabulary travel with the task, so they are lists that a person keeps (a
    list of millions of hosts belongs into a table joined by host).
    """
    index = _rule_index(rules)
    kind = "rule string, rule_verdict string, strict int, soft int, score double"

    @F.pandas_udf(kind)
    def search(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        found = _automaton(vocabulary)
        for urls, hosts, paths in batches:
            rows = []
            for url, host, path in zip(urls, hosts, paths, strict=True):
                hits = _hits(url.lower(), found, vocabulary) if url and vocabulary else ()
                rule = _rule_for(host, path, index) if host else None
                strict = sum(vocabulary[i].strict for i in hits)
                score = sum(vocabulary[i].weight for i in sorted(hits))
                rows.append((rule and rule.name, rule and rule.verdict, strict, len(hits) - strict, score))
            yield pd.DataFrame(rows, columns=["rule", "rule_verdict", "strict", "soft", "score"])

    url = F.col(f"`{url_col}`")
    found = pages.withColumn("_found", search(url, host_of(url), path_of(url)))
    method = F.when((F.col("_found.strict") >= 1) | (F.col("_found.soft") >= min_soft), "block").otherwise("allow")
    return found.withColumn(
        "_url",
        F.struct(
            host_of(url).alias("host"), path_of(url).alias("path"), F.col("_found.rule").alias("rule"),
            F.col("_found.strict").alias("strict"), F.col("_found.soft").alias("soft"), F.col("_found.score").alias("score"),
            F.coalesce(F.col("_found.rule_verdict"), method).alias("verdict"),
        ),
    ).drop("_found")


def query(pages: DataFrame) -> DataFrame:
    judged = judge(view(pages, page_id="page_id", url="url"))
    return judged.select("page_id", "_url.host", "_url.path", "_url.rule", "_url.verdict", "_url.strict", "_url.soft", "_url.score")


def _sql() -> str:
    bounded = lambda t: f"regexp_matches(u, '{t.text}')" if t.anywhere else rf"regexp_matches(u, '(^|[^\p{{L}}\p{{N}}]){t.text}([^\p{{L}}\p{{N}}]|$)')"
    count = lambda terms: " + ".join(f"{bounded(t)}::INT" for t in terms)
    score = " + ".join(f"{t.weight} * {bounded(t)}::INT" for t in VOCABULARY)
    fits = lambda r: f"((host = '{r.host}' OR host LIKE '%.{r.host}') AND starts_with(path, '{r.path}'))"
    ordered = sorted(HOST_RULES, key=lambda r: -len(r.name))
    return rf"""
    WITH p AS (SELECT page_id, lower(coalesce(url, '')) AS u,
                      translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                      regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
    h AS (SELECT page_id, host, path, CASE {' '.join(f"WHEN {fits(r)} THEN '{r.name}'" for r in ordered)} END AS rule,
                 CASE {' '.join(f"WHEN {fits(r)} THEN '{r.verdict}'" for r in ordered)} END AS ruled,
                 {count([t for t in VOCABULARY if t.strict])} AS strict, {count([t for t in VOCABULARY if not t.strict])} AS soft, ({score})::DOUBLE AS score FROM p)
    SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN strict >= 1 OR soft >= {MIN_SOFT} THEN 'block' ELSE 'allow' END) AS verdict, strict, soft, score FROM h"""


SQL = _sql()
