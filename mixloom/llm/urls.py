"""URL filters: host and path rules, then a weighted vocabulary matched by Aho-Corasick with boundary checks."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from urllib.parse import unquote

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from mixloom.llm.arrow import with_columns

STRICT, SOFT = "strict", "soft"
# Vocabulary: one strict term rejects a url, soft ones from SOFT_LIMIT different terms on. Whole words anywhere in the url;
# a term may hold hyphens.
VOCABULARY = {
    **dict.fromkeys(
        "porn porno xxx sex hentai camgirl camgirls escort escorts casino casinos viagra cialis warez malware phishing"
        " spam spam-farm ads-track cheap-pills free-bets casino-win adult-x".split(),
        STRICT,
    ),
    **dict.fromkeys(
        "adult adults bet bets betting poker slots jackpot gambling lottery pills pharmacy drugs cheap free win winner"
        " bonus crack torrent keygen dating hot nude naked loan loans payday crypto track tracker ads adserver popup"
        " replica clickbait farm".split(),
        SOFT,
    ),
}
SOFT_LIMIT = 2
# How often percent-encoding is undone, as an encoded sign may be encoded again.
DECODINGS = 2
# The rules of the registered query, (verdict, host and path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without `://`. Nothing else of the url is interpreted."""
    if not url:
        return "", ""
    at = url.find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    stop = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    host, tail = rest[:stop], rest[stop:]
    end = min((i for i in (tail.find(c) for c in "?#") if i >= 0), default=len(tail))
    return "".join([chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host]), tail[:end]


def decoded(url: str) -> str:
    """The url without percent-encoding; bytes that are no UTF-8 become signs that belong to no word."""
    for _ in range(DECODINGS):
        if "%" not in url:
            break
        url = unquote(url)
    return url


class UrlFilter:
    """Verdicts of one rule set and vocabulary."""

    def __init__(self, rules: Iterable[tuple[str, str]], vocabulary: Mapping[str, str], soft_limit: int):
        self.rules: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, rule in rules:
            host, slash, path = rule.partition("/")
            self.rules.setdefault(host, []).append((slash + path, rule, verdict))
        self.soft_limit = soft_limit
        self.terms = ahocorasick.Automaton()
        for term, kind in vocabulary.items():
            self.terms.add_word(term, (term, kind))
        self.terms.make_automaton()

    def rule(self, host: str, path: str) -> tuple[str | None, str | None]:
        """The longest rule of the host or a domain above it whose path begins the url's, and its verdict."""
        best: tuple[int, str, str] | None = None
        domain = host
        while domain:
            for start, rule, verdict in self.rules.get(domain, ()):
                if path.startswith(start) and (best is None or len(rule) > best[0]):
                    best = len(rule), rule, verdict
            domain = domain.partition(".")[2]
        return best[1:] if best else (None, None)

    def hits(self, url: str) -> tuple[set[str], set[str]]:
        """Different strict and soft terms; a letter or digit next to a term makes it part of another word."""
        found: dict[str, set[str]] = {STRICT: set(), SOFT: set()}
        if len(self.terms):
            for last, (term, kind) in self.terms.iter(url):
                first = last + 1 - len(term)
                before, after = url[first - 1 : first] if first else "", url[last + 1 : last + 2]
                if not before.isalnum() and not after.isalnum():
                    found[kind].add(term)
        return found[STRICT], found[SOFT]

    def judge(self, url: str | None) -> tuple[str, str, str | None, str, int, int]:
        host, path = split_url(url)
        rule, verdict = self.rule(host, path)
        strict, soft = self.hits(decoded(url or "").lower())
        if verdict is None:
            verdict = "block" if strict or len(soft) >= self.soft_limit else "allow"
        return host, path, rule, verdict, len(strict), len(soft)


def url_verdicts(
    pages: DataFrame,
    url: str = "url",
    rules: Sequence[tuple[str, str]] = RULES,
    vocabulary: Mapping[str, str] = VOCABULARY,
    soft_limit: int = SOFT_LIMIT,
) -> DataFrame:
    """Add host, path, the rule that fits, the verdict and the numbers of strict and soft terms to every row.

    A rule fits its host and all subdomains if the path begins with the rule's path; the longest rule wins. Without a
    rule the vocabulary decides over the whole url, percent-decoded, with query and fragment: one strict term or `soft_limit` different soft
    ones block. A null url, or one without `://`, has empty host and path, so no rule fits; a null url is allowed.
    """
    rules, vocabulary = tuple(rules), dict(vocabulary)

    def kernel():
        judge = UrlFilter(rules, vocabulary, soft_limit).judge

        def run(column):
            rows = [judge(u) for u in column.to_pylist()]
            kinds = (pa.string(),) * 4 + (pa.int64(),) * 2
            return [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]

        return run

    added = "host string, path string, rule string, verdict string, strict_hits bigint, soft_hits bigint"
    return with_columns(pages, url, added, kernel)
