"""Quality rules as a bitmask ledger.

`ledger` evaluates every rule once for each document and keeps its measurements and one
failure bit per rule. A policy is a version name with the mask of rules that it enforces;
`apply_policy` is one bitwise AND on the ledger, no text is read again. `ablations` counts,
for each policy and rule, what the rule rejects and what it alone rejects, from the ledger's
bit patterns, which are summed before any exchange (at most 2 ** rules of them).

A window of five words counts by a 64-bit chained hash of its words within its own text.
Windows are sorted with their places, so equal ones stand side by side, and a text of n
words takes n log n steps; texts whose hashes are all distinct skip the sort.

Defined cases: null and empty texts have no words and fail min_words; a text with fewer
than five words has no window; ties and repeated rows are measured alike; an empty table
gives no rows; extra columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediacat.llm.common import SPACE, WORD, table, words

WINDOW = 5
_NOT_SYMBOL = r"[^#*$%&|<>]+"

#: Rules in the order of their bits; each is true for a document that fails it.
RULES: dict[str, str] = {
    "min_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "word_length": "n_words > 0 and (word_chars < 2 * n_words or word_chars > 20 * n_words)",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "shouting": "n_words > 0 and 2 * n_marks > n_words",
}
BASE = ("min_words", "repeated_words")
#: Versioned policies: the rules that each enforces.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "v1": (*BASE, "symbols", "word_length", "repeated_lines"),
    "v2": (*BASE, "symbols", "word_length", "repeated_lines", "shouting"),
}
CURRENT = "v2"


def mask(policy: str) -> int:
    return sum(1 << list(RULES).index(r) for r in POLICIES[policy])


def _repeat_words(w: str) -> str:
    """SQL: words of array w in windows of five that occur twice or more."""
    at = ", ".join(f"{w}[i + {k}]" for k in range(WINDOW))
    hashes = f"transform(sequence(0, size({w}) - {WINDOW}), i -> xxhash64({at}))"
    # places of repeated windows in order, then the length of the union of [p, p + 5)
    places = "array_sort(transform(filter(sequence(0, size(s) - 1), k -> (k > 0 and s[k].h = s[k - 1].h) or (k + 1 < size(s) and s[k].h = s[k + 1].h)), k -> s[k].p))"
    covered = f"size(d) * {WINDOW} - aggregate(sequence(1, size(d) - 1, 1), 0, (a, k) -> a + greatest(0, {WINDOW} - (d[k] - d[k - 1])))"
    let = lambda name, value, body: f"element_at(transform(array({value}), {name} -> {body}), 1)"
    sort = "sort_array(transform(h, (x, i) -> named_struct('h', x, 'p', i)))"
    inner = let("s", sort, let("d", places, covered))
    return f"cast(case when size({w}) < {WINDOW} then 0 else {let('h', hashes, f'case when size(array_distinct(h)) = size(h) then 0 else {inner} end')} end as bigint)"


def measured(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row a document with the measurements that the rules read."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key), t.alias("_t")).withColumn("_w", words(F.col("_t"))).withColumn("_lines", F.filter(F.split("_t", "\n"), lambda x: F.rlike(x, F.lit(WORD))))
    return rows.select(
        key,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("_t", f"{SPACE}+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_t", _NOT_SYMBOL, "")).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.expr(_repeat_words("_w")).alias("n_repeat_words"),
        F.length(F.regexp_replace("_t", "[^!?]+", "")).cast("long").alias("n_marks"),
    )


def ledger(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Measurements and `fail_bits` (long), one bit for each rule of RULES."""
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, rule in enumerate(RULES.values())]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return measured(docs, text, key).withColumn("fail_bits", out)


def passes(policy: str, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def apply_policy(rows: DataFrame, policy: str) -> DataFrame:
    """The ledger's rows that a policy keeps."""
    return rows.filter(passes(policy))


def ablations(rows: DataFrame) -> DataFrame:
    """policy, rule, n_rejected, n_failed, n_only: rows the policy rejects, the rule fails, the rule alone rejects."""
    patterns = rows.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    pairs = F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(mask(p)).cast("long").alias("mask"), F.lit(r).alias("rule"), F.lit(1 << list(RULES).index(r)).cast("long").alias("bit")) for p, rules in POLICIES.items() for r in rules])
    each = patterns.select("fail_bits", "n", F.inline(pairs))
    hit = F.col("fail_bits").bitwiseAND(F.col("mask"))
    count = lambda on: F.coalesce(F.sum(F.when(on, F.col("n"))), F.lit(0)).alias
    return each.groupBy("policy", "rule").agg(count(hit != 0)("n_rejected"), count(hit.bitwiseAND(F.col("bit")) != 0)("n_failed"), count(hit == F.col("bit"))("n_only"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~passes("base")).alias("base_failed"), passes(CURRENT).alias("kept"), "fail_bits")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ablations of all policies over the ledger of all documents."""
    return ablations(ledger(table(spark, sf_dir, "documents")))


_SQL_BITS = " + ".join(f"CASE WHEN {r} THEN {1 << i} ELSE 0 END" for i, r in enumerate(RULES.values()))
_LEDGER = f"""
WITH t AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS t FROM documents),
w AS (SELECT row, list_filter(regexp_split_to_array(t, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS w FROM t),
g AS (SELECT row, i, list_slice(w, i, i + 4) AS g FROM (SELECT row, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
r AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, g) AS n FROM g) WHERE n > 1),
n AS (SELECT row, sum(least(5, coalesce(nxt - i, 5)))::BIGINT AS n_repeat_words FROM (SELECT row, i, lead(i) OVER (PARTITION BY row ORDER BY i) AS nxt FROM r) GROUP BY row),
l AS (SELECT row, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0b\\f\\r]')) AS l FROM t),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[ \\t\\n\\x0b\\f\\r]+', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, length(regexp_replace(t, '[^!?]+', '', 'g'))::BIGINT AS n_marks
  FROM t JOIN w USING (row) JOIN l USING (row) LEFT JOIN n USING (row)),
b AS (SELECT *, ({_SQL_BITS})::BIGINT AS fail_bits FROM m)"""
_PAIRS = ", ".join(f"('{p}', {mask(p)}, '{r}', {1 << list(RULES).index(r)})" for p, rules in POLICIES.items() for r in rules)
SQL = {
    "op1_quality_rules": f"""{_LEDGER}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & {mask("base")}) <> 0 AS base_failed, (fail_bits & {mask(CURRENT)}) = 0 AS kept, fail_bits FROM b""",
    "quality_ablations": f"""{_LEDGER},
pairs(policy, mask, rule, bit) AS (VALUES {_PAIRS})
SELECT policy, rule, count(*) FILTER (WHERE fail_bits & mask <> 0) AS n_rejected, count(*) FILTER (WHERE fail_bits & bit <> 0) AS n_failed, count(*) FILTER (WHERE fail_bits & mask = bit) AS n_only FROM pairs, b GROUP BY policy, rule""",
}
