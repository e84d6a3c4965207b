"""Quality rules as a bitmask ledger.

Every rule is evaluated once a text; the ledger keeps one bit a rule that failed and the
measurements behind the bits. A policy is a version with a mask of bits, so that policies
and their ablations are bit operations over the ledger and read no text again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, numbered, place, renamed, table, without

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_letters long, n_shouts long"


@dataclass(frozen=True)
class Rule:
    """A rule fails where its SQL condition over the measurements holds."""

    name: str
    bit: int
    fails: str


RULES = (
    Rule("few_words", 0, "n_words < 50"),
    Rule("repeated_windows", 1, "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", 2, "10 * n_symbols > 3 * n_words"),
    Rule("duplicate_lines", 3, "n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines"),
    Rule("upper_case", 4, "n_letters >= 20 AND 100 * n_upper > 60 * n_letters"),
    Rule("shouting", 5, "10 * n_shouts > n_words"),
    Rule("long_words", 6, "n_words > 0 AND word_chars > 40 * n_words"),
)
#: Versions of the policy and the rules that they hold; a version is never changed once used.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "duplicate_lines"),
    "v2": tuple(r.name for r in RULES),
}


def repeated_window_words(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a window of ``width`` words which the text holds twice or more."""
    n = len(words)
    if n <= width:
        return 0
    ids = {w: i for i, w in enumerate(set(words))}
    v = np.fromiter(map(ids.__getitem__, words), np.int64, n)
    code = v
    for k in range(1, width):
        if int(code.max()) * len(ids) > 1 << 61:
            code = np.unique(code, return_inverse=True)[1].astype(np.int64)
        code = code[: n - k] * len(ids) + v[k:]
    order = np.argsort(code, kind="stable")
    s = code[order]
    same = s[1:] == s[:-1]
    again = np.zeros(len(code), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    inside = np.zeros(n, bool)
    for k in range(width):
        inside[k : n - width + 1 + k] |= again
    return int(inside.sum())


def measure(text: bytes | None) -> tuple:
    text = text or b""
    words = text.split()
    lines = text.split(b"\n")
    used = [x for x in lines if x.strip()]
    letters = sum(map(len, words)) - len(b"".join(words).translate(None, UPPER + UPPER.lower()))
    return (
        len(words),
        len(b"".join(words).decode("utf-8", "replace")),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(used) - len(set(used)),
        repeated_window_words(words),
        len(used),
        len(text) - len(text.translate(None, UPPER)),
        letters,
        text.count(b"!!"),
    )


def ledger(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add the measurements and ``failures``, a long with bit ``r.bit`` set where rule ``r`` fails.

    A null text counts as empty. Repeated rows give repeated rows. The text goes; columns named
    like a result, in any case, are replaced and all others carried along. An empty table gives
    an empty ledger.
    """
    names = [x.split()[0] for x in MEASURES.split(", ")]
    kept = [k for k in without(df, *names, "failures") if k != place(df, text_col)]
    bits = " + ".join(["0L", *(f"CASE WHEN {r.fails} THEN {1 << r.bit}L ELSE 0L END" for r in rules)])
    made = map_texts(numbered(df), lambda: measure, MEASURES, f"c{place(df, text_col)}").withColumn("failures", F.expr(bits))
    return renamed(made, df, kept, *names, "failures")


def mask(policy: str | tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    """The bits of a policy, a version's name or the names of its rules; a name without a rule is an error."""
    names = POLICIES[policy] if isinstance(policy, str) else policy
    bits = {r.name: 1 << r.bit for r in rules}
    return sum(bits[n] for n in dict.fromkeys(names))


def apply_policy(book: DataFrame, policy: str | tuple[str, ...], kept_col: str = "kept", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Append whether no rule of the policy failed, by the ledger's bits alone.

    ``rules`` are those that the ledger was made with. A column of the result's name, in any
    case, is replaced. A null ``failures`` gives null.
    """
    kept = without(book, kept_col)
    made = F.col(f"c{place(book, 'failures')}").bitwiseAND(F.lit(mask(policy, rules))) == 0
    return numbered(book).select(*[f"c{k}" for k in kept], made).toDF(*[book.columns[k] for k in kept], kept_col)


def ablate(book: DataFrame, policy: str | tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(rule, rejected, rejected_alone, kept_without): one row a rule of the policy.

    Rows that the rule rejects, that it alone rejects, and that the policy would keep without it.
    Rows are first counted by failure pattern, of which there are at most 2^rules. An empty
    ledger gives no row; rows with null ``failures`` aren't counted.
    """
    whole = mask(policy, rules)
    held = [r for r in rules if whole >> r.bit & 1]
    patterns = numbered(book).select(F.col(f"c{place(book, 'failures')}").bitwiseAND(F.lit(whole)).alias("bits")).filter("bits IS NOT NULL").groupBy("bits").agg(F.count("*").alias("n"))
    each = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in held])).alias("r")
    total = lambda hit: F.sum(F.when(hit, F.col("n")).otherwise(0))
    return patterns.select("bits", "n", each).groupBy(F.col("r.rule").alias("rule")).agg(
        total(F.col("bits").bitwiseAND(F.col("r.bit")) != 0).alias("rejected"),
        total(F.col("bits") == F.col("r.bit")).alias("rejected_alone"),
        total(F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0).alias("kept_without"),
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = apply_policy(apply_policy(ledger(table(spark, sf_dir, "documents").select("doc_id", "text")), "base", "base_kept"), "v2")
    without_one = [F.col("failures").bitwiseAND(F.lit(mask("v2") & ~mask((name,)))) == 0 for name in POLICIES["v2"]]
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("base_kept")).alias("base_failed"), "kept", "failures",
        # the ablation of each rule: the rules without one of which the document would be kept
        F.array_join(F.array_compact(F.array(*[F.when(~F.col("kept") & free, name) for name, free in zip(POLICIES["v2"], without_one)])), " ").alias("rejected_alone_by"),
    )


OP7_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents
), split AS (
  SELECT k, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS used FROM docs
), windows AS (
  SELECT k, unnest(range(1, len(w) - 1)) AS place, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS x FROM split WHERE len(w) >= 3
), again AS (
  SELECT k, place FROM windows QUALIFY count(*) OVER (PARTITION BY k, x) > 1
), inside AS (
  SELECT k, count(DISTINCT place + j) AS n FROM again, (SELECT unnest([0, 1, 2]) AS j) GROUP BY k
), measured AS (
  SELECT k, doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
         length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, len(used) - len(list_distinct(used)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(used) AS n_lines,
         length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper, length(t) - length(regexp_replace(t, '[A-Za-z]', '', 'g')) AS n_letters, len(regexp_extract_all(t, '!!')) AS n_shouts
  FROM split LEFT JOIN inside USING (k)
), failed AS (
  SELECT *, n_words < 50 AS f0, 100 * n_repeat_words > 50 * n_words AS f1, 10 * n_symbols > 3 * n_words AS f2, n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines AS f3,
         n_letters >= 20 AND 100 * n_upper > 60 * n_letters AS f4, 10 * n_shouts > n_words AS f5, n_words > 0 AND word_chars > 40 * n_words AS f6 FROM measured
), ledger AS (
  SELECT *, CAST(f0 AS BIGINT) + 2 * CAST(f1 AS BIGINT) + 4 * CAST(f2 AS BIGINT) + 8 * CAST(f3 AS BIGINT) + 16 * CAST(f4 AS BIGINT) + 32 * CAST(f5 AS BIGINT) + 64 * CAST(f6 AS BIGINT) AS failures FROM failed
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, f0 OR f1 AS base_failed, failures = 0 AS kept, failures,
       CASE failures WHEN 1 THEN 'few_words' WHEN 2 THEN 'repeated_windows' WHEN 4 THEN 'symbols' WHEN 8 THEN 'duplicate_lines' WHEN 16 THEN 'upper_case' WHEN 32 THEN 'shouting' WHEN 64 THEN 'long_words' ELSE '' END AS rejected_alone_by
FROM ledger
"""
