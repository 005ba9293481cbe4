"""URL filters: pattern rules indexed by their rarest literal token.

A rule names a host and a path prefix and an action.  It becomes one regular
expression, and is filed under the one of its literal tokens that the fewest
rules have.  A URL's tokens fetch the rules filed under them; only those run
their expressions, and the longest that matches decides.  The work for a URL
follows its tokens, not the number of rules.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
lower-cased.  Path: from there up to ``?``, ``#`` or the end.  A rule fits its
host and all subdomains if the path starts with the rule's.

Defined cases: a null URL or one without ``://`` has empty host and path and
matches no rule; an unmatched URL gets the default verdict; two rules of equal
length cannot both fit one URL unless they are the same text, and then the
first given holds; rows repeat as they are; the rule set is a list held by the
driver and is refused beyond ``MAX_RULES``.  All columns of the input except
the URL are passed over, whatever their names; the id may be null.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import once_a_worker

MAX_RULES = 500_000
OUT = "id long, host string, path string, rule string, verdict string"

#: (action, host, path)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

_TOKEN = re.compile(r"[^./?#\x00-\x20]+")


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path of a URL."""
    if url is None:
        return "", ""
    _, mark, rest = url.partition("://")
    if not mark:
        return "", ""
    end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    path = rest[end:]
    stop = next((i for i, c in enumerate(path) if c in "?#"), len(path))
    host = rest[:end]
    lowered = host.lower() if host.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), host)
    return lowered, path[:stop]


class RuleIndex:
    """Rules by their rarest literal token."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        if len(rules) > MAX_RULES:
            raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} are held by each worker")
        # A path's last token may be cut short by the prefix, so only whole path tokens are literal ones.
        literal = [set(_TOKEN.findall(host)) | set(_TOKEN.findall(path.rpartition("/")[0])) for _, host, path in rules]
        common = Counter(t for own in literal for t in own)
        self.by_token: dict[str, list[tuple[int, str, str, str]]] = {}
        self.rest: list[tuple[int, str, str, str]] = []
        self.patterns: dict[int, re.Pattern] = {}
        for n, ((action, host, path), own) in enumerate(zip(rules, literal, strict=True)):
            entry = (n, host + path, action, rf"(?:.*\.)?{re.escape(host)}\n{re.escape(path)}.*")
            if own:
                self.by_token.setdefault(min(own, key=lambda t: (common[t], -len(t), t)), []).append(entry)
            else:
                self.rest.append(entry)

    def _fits(self, n: int, expression: str, both: str) -> bool:
        """Expressions are compiled when a URL first asks for them."""
        if n not in self.patterns:
            self.patterns[n] = re.compile(expression, re.DOTALL)
        return bool(self.patterns[n].fullmatch(both))

    def candidates(self, host: str, path: str) -> Iterator[tuple[int, str, str, str]]:
        yield from self.rest
        for token in {*_TOKEN.findall(host), *_TOKEN.findall(path)}:
            yield from self.by_token.get(token, ())

    def decide(self, host: str, path: str) -> tuple[str | None, str | None]:
        """The longest rule that fits and its action."""
        both = f"{host}\n{path}"
        fit = [(-len(text), n, text, action) for n, text, action, expression in self.candidates(host, path) if self._fits(n, expression, both)]
        return min(fit)[2:] if fit else (None, None)


def judge_urls(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str, str]] = RULES, default: str = "allow") -> DataFrame:
    """One row per input row: ``id, host, path, rule, verdict``.  No shuffle."""
    rules = list(rules)
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} are held by each worker")
    shared = df.sparkSession.sparkContext.broadcast(rules)  # at most MAX_RULES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = once_a_worker(shared, RuleIndex)
        for batch in batches:
            hosts, paths, names, verdicts = [], [], [], []
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                name, action = index.decide(host, path) if host else (None, None)
                hosts.append(host)
                paths.append(path)
                names.append(name)
                verdicts.append(action or default)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.string()) for x in (hosts, paths, names, verdicts))], names=["id", "host", "path", "rule", "verdict"])

    two = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"))
    return two.mapInArrow(run, OUT)
