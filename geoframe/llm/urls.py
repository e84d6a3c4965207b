"""URL filters: explicit host and path rules, then association rules mined from labelled URLs.

The labels are the verdicts of the explicit rules on the URLs that they fit, so that what the
rules say of known hosts and paths carries over, by FP-growth, to URLs that none of them fits.
"""

from __future__ import annotations

import re
from itertools import combinations
from typing import NamedTuple

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, map_texts, numbered, place, renamed, table, without

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TO_LOWER = str.maketrans(UPPER, LOWER)
HEAD, WORD = re.compile(r"[^/?#]*"), re.compile(r"[^/._~+,;:=&%!()\-]+")
BAD = "!block"
MOST_RULES = 1_000_000  # mined rules that the driver takes


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z in lower case, and path; both empty for a null url or one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _cut(pages: DataFrame, url_col: str) -> DataFrame:
    """Columns c<k> of ``pages``, and u, host and path of the url."""
    url = F.col(f"c{place(pages, url_col)}")
    host, path = host_and_path(url)
    return numbered(pages).withColumns({"u": url, "host": host, "path": path})


def match_rule(host: str, path: str, index: dict[str, list[tuple[str, str]]]) -> tuple[str | None, str | None]:
    """The longest rule that fits, and its verdict; of two as long, that of the longer host."""
    best: tuple[int, int, str, str] | None = None
    at = 0
    while True:
        own = host[at:]
        for start, verdict in index.get(own, ()):
            if path.startswith(start):
                found = (len(own) + len(start), len(own), own + start, verdict)
                best = max(best, found) if best else found
        at = host.find(".", at) + 1
        if not at:
            break
    return (best[2], best[3]) if best else (None, None)


def tokens(url: str) -> list[str]:
    """Distinct tokens of a whole URL, A-Z in lower case.

    ``s:`` the scheme, ``h:`` each label of the host, ``p:`` each word of the path, ``q:`` each
    part of the query and, where it has a value, its key, ``f:`` the fragment. A url without
    ``://`` has none.
    """
    scheme, mark, rest = url.translate(TO_LOWER).partition("://")
    if not mark:
        return []
    head = HEAD.match(rest)[0]
    path, _, fragment = rest[len(head) :].partition("#")
    path, _, query = path.partition("?")
    parts = [x for x in query.split("&") if x]
    out = {f"s:{scheme}", *(f"h:{x}" for x in head.split(".") if x), *(f"p:{x}" for x in WORD.findall(path))}
    out |= {f"q:{x}" for x in parts} | {f"q:{x.split('=')[0]}" for x in parts} | ({f"f:{fragment}"} if fragment else set())
    return sorted(out)


def mine(labelled: DataFrame, min_support: float = 0.01, min_confidence: float = 0.95, min_count: int = 20) -> list[tuple[tuple[str, ...], float]]:
    """Token sets that imply a block, from (tokens, label), by FP-growth.

    Support and confidence prune the rules: a set must come with a block in ``min_support`` of
    the URLs and in ``min_count`` of them, and ``min_confidence`` of its URLs must be blocked. A
    rule goes if a part of its tokens implies a block with as much confidence. More than
    MOST_RULES rules are an error rather than a cut: raise the support. Null tokens or labels
    count as none and as 0; no labelled row or no bad one: no rules.
    """
    carts = labelled.select(F.when(F.col("label") == 1, F.array_append("tokens", F.lit(BAD))).otherwise(F.col("tokens")).alias("items")).filter(F.size("items") > 0)
    n = carts.count()
    if n < min_count:
        return []
    model = FPGrowth(itemsCol="items", minSupport=max(min_support, min_count / n), minConfidence=min_confidence).fit(carts)
    rows = model.associationRules.filter(F.array_contains("consequent", BAD)).select("antecedent", "confidence").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"over {MOST_RULES} rules; raise min_support")
    rules = {frozenset(r.antecedent): r.confidence for r in rows}
    sizes = sorted({len(own) for own in rules})
    kept: dict[frozenset, float] = {}
    for own, sure in sorted(rules.items(), key=lambda x: (len(x[0]), sorted(x[0]))):
        parts = (frozenset(x) for k in sizes if k < len(own) for x in combinations(sorted(own), k))
        if not any(kept.get(x, -1.0) >= sure for x in parts):
            kept[own] = sure
    return [(tuple(sorted(own)), sure) for own, sure in kept.items()]


def judge(pages: DataFrame, mined: list[tuple[tuple[str, ...], float]], rules: tuple[Rule, ...] = RULES, url_col: str = "url") -> DataFrame:
    """Append host, path, rule, verdict and mined, the tokens of the mined rule that decided.

    The explicit rule decides where one fits; else a URL that holds all tokens of a mined rule
    is blocked, and any other allowed. Mined rules are found through an inverted index from
    their rarest token; of several the surest is named, then the shortest, then the first. A
    null or malformed URL has an empty host and path, no rule, and is allowed. Columns named like
    a result, in any case, are replaced; all others are carried along. Repeated rows are judged
    alike. No page: no row.
    """
    index: dict[str, list[tuple[str, str]]] = {}
    for r in rules:
        index.setdefault(r.host, []).append((r.path, r.verdict))
    often: dict[str, int] = {}
    for own, _ in mined:
        for x in own:
            often[x] = often.get(x, 0) + 1
    inverted: dict[str, list[tuple[float, int, tuple[str, ...]]]] = {}
    for own, sure in mined:
        inverted.setdefault(min(own, key=lambda x: (often[x], x)), []).append((-sure, len(own), own))
    shared = pages.sparkSession.sparkContext.broadcast((index, inverted))  # rule lists, bounded in mine()

    def each():
        index, inverted = shared.value

        def call(*given):
            url, host, path = ((x or b"").decode("utf-8", "replace") for x in given)
            rule, verdict = match_rule(host, path, index)
            if verdict is not None:
                return host, path, rule, verdict, None
            own = set(tokens(url))
            hit = min((r for x in own for r in inverted.get(x, ()) if own.issuperset(r[2])), default=None)
            return host, path, None, "allow" if hit is None else "block", None if hit is None else list(hit[2])

        return call

    made = map_texts(_cut(pages, url_col), each, "host string, path string, rule string, verdict string, mined array<string>", "u", "host", "path")
    return renamed(made, pages, without(pages, "host", "path", "rule", "verdict", "mined"), "host", "path", "rule", "verdict", "mined")


def label_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, url_col: str = "url") -> DataFrame:
    """(tokens, label) of the URLs that an explicit rule decides: 1 for a block, 0 for an allowance.

    These are labels that concern URLs; any other table of (tokens, label) will do for ``mine``.
    A null or malformed URL and one that no rule fits have no label.
    """
    index: dict[str, list[tuple[str, str]]] = {}
    for r in rules:
        index.setdefault(r.host, []).append((r.path, r.verdict))

    def call(*given):
        url, host, path = ((x or b"").decode("utf-8", "replace") for x in given)
        _, verdict = match_rule(host, path, index)
        return (None, None) if verdict is None else (tokens(url), int(verdict == "block"))

    given = _cut(pages, url_col).select("u", "host", "path")
    return map_texts(given, lambda: call, "tokens array<string>, label int", "u", "host", "path").filter("label IS NOT NULL")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    mined = mine(durable(label_urls(pages)))
    return judge(pages, mined).select("page_id", "host", "path", "rule", "verdict", F.array_join("mined", " ").alias("mined"))


#: Every set of the frequent tokens of a labelled URL is counted; a URL that holds a sure one is blocked.
OP2_SQL = r"""
WITH cut AS (
  SELECT row_number() OVER () AS k, page_id, coalesce(url, '') AS url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT *, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), rules(verdict, h, p) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), ruled AS (
  SELECT k, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
  FROM split JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY k
), lowered AS (
  SELECT k, translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS u FROM split WHERE instr(url, '://') > 0
), parts AS (
  SELECT k, substr(u, 1, instr(u, '://') - 1) AS scheme, substr(u, instr(u, '://') + 3) AS rest FROM lowered
), fields AS (
  SELECT k, scheme, regexp_extract(rest, '^[^/?#]*') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
         regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) AS query, regexp_extract(rest, '^[^#]*#((?s:.*))$', 1) AS fragment FROM parts
), tokens AS (
  SELECT DISTINCT k, unnest(list_concat(['s:' || scheme], list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'h:' || x),
    list_transform(regexp_extract_all(path, '[^/._~+,;:=&%!()\-]+'), lambda x: 'p:' || x),
    list_transform(list_filter(string_split(query, '&'), lambda x: x <> ''), lambda x: 'q:' || x),
    list_transform(list_filter(string_split(query, '&'), lambda x: x <> ''), lambda x: 'q:' || string_split(x, '=')[1]),
    CASE WHEN fragment <> '' THEN ['f:' || fragment] ELSE [] END)) AS t FROM fields
), n AS (
  SELECT count(*) AS n, greatest(20, ceil(greatest(0.01, 20.0 / count(*)) * count(*) - 1e-9)) AS least FROM ruled
), often AS (
  SELECT t FROM tokens JOIN ruled USING (k), n WHERE verdict = 'block' GROUP BY t, least HAVING count(*) >= least
), carts AS (
  SELECT k, verdict, list(t ORDER BY t) AS ts FROM tokens JOIN often USING (t) JOIN ruled USING (k) GROUP BY k, verdict
), subsets AS (
  SELECT k, verdict, list_filter(ts, lambda x, i: (m >> CAST(i - 1 AS INTEGER)) & 1 = 1) AS own FROM carts, LATERAL (SELECT unnest(range(1, CAST(1 AS BIGINT) << CAST(len(ts) AS INTEGER))) AS m)
), sure AS (
  SELECT own, count(*) FILTER (verdict = 'block') / count(*) AS c FROM subsets, n GROUP BY own, least HAVING count(*) FILTER (verdict = 'block') >= least AND count(*) FILTER (verdict = 'block') / count(*) >= 0.95
), minimal AS (
  SELECT own, c FROM sure s WHERE NOT EXISTS (SELECT 1 FROM sure o WHERE len(o.own) < len(s.own) AND o.c >= s.c AND list_has_all(s.own, o.own))
), rest AS (
  SELECT k, list(t) AS ts FROM tokens WHERE k NOT IN (SELECT k FROM ruled) GROUP BY k
), hits AS (
  SELECT k, own, row_number() OVER (PARTITION BY k ORDER BY c DESC, len(own), own) AS place FROM rest JOIN minimal ON list_has_all(ts, own)
)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN own IS NULL THEN 'allow' ELSE 'block' END) AS verdict, array_to_string(own, ' ') AS mined
FROM split LEFT JOIN ruled USING (k) LEFT JOIN (SELECT * FROM hits WHERE place = 1) USING (k)
"""
