"""Quality rules as a short-circuit cascade, in the order of rejection per cost measured on a sample.

Each rule is a built-in expression that is true for a text to reject. ``plan_cascade`` times every rule on a bounded
sample (``SAMPLE_ROWS`` texts of at most ``SAMPLE_CHARS`` characters, from as few partitions as hold them) and counts what
it rejects there; the sample only orders the rules. The cascade is one CASE:
a text that a rule rejects isn't looked at by the rules behind it. What is kept doesn't depend on the order.

A line is a run of characters between newlines without the blanks ahead of it; blank lines don't count as lines.

Defined results: a null, empty or blank text is rejected as ``blank``; other columns may be null and have any name;
repeated rows are judged alike and stay repeated; an empty table gives an empty result.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fossick.llm.common import col, fresh

#: Rows of the sample that orders the rules.
SAMPLE_ROWS = 2000
#: Characters of the longest text in it: it comes to the driver.
SAMPLE_CHARS = 1 << 15
#: Share of the rows of a partition that may come into the sample.
SAMPLE_SHARE = 0.05
#: Words are maximal runs of characters other than these blanks, in Spark and in the SQL.
WORD = r"[^ \t\n\r\f]+"
SYMBOL = r"[#$%&*|!<>{}\\^~]"


@dataclass(frozen=True)
class Rule:
    """``when``: SQL over ``text`` that both engines read, with {words} etc. filled in for each."""

    name: str
    when: str


#: In the order in which ``reason`` names them. No rule may be null for a text.
RULES = (
    Rule("blank", "{words} = 0"),
    # of 10 words or more, marks other than punctuation: more than one in five words
    Rule("symbols", "{symbols} > 2 AND {symbols} > 0.2 * {words}"),
    Rule("shouting", "{words} >= 3 AND {upper} > 0.4 * length(text)"),
    Rule("digits", "{words} >= 5 AND {digits} > 0.5 * length(text)"),
    Rule("word_length", "{words} >= 5 AND (length(text) > 16 * {words} OR length(text) < 2.5 * {words})"),
    # of the lines that aren't blank more than two fifths repeat an earlier one
    Rule("repeated_lines", "{lines} >= 5 AND {distinct_lines} < 0.6 * {lines}"),
    # the number of different words grows with the root of the length in prose, not in repetitions
    Rule("repeated_words", "{words} >= 20 AND CAST({distinct_words} AS BIGINT) * {distinct_words} < 4 * CAST({words} AS BIGINT)"),
)

_SPARK_LINES = r"split(trim(BOTH concat(' ', char(9), char(10), char(13)) FROM text), r'\n[ \t\n\r]*')"
_DUCK_LINES = r"regexp_split_to_array(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '\n[ \t\n\r]*')"
_SPARK = {
    "words": f"regexp_count(text, r'{WORD}')", "symbols": f"regexp_count(text, r'{SYMBOL}')", "upper": r"regexp_count(text, r'\p{Lu}')", "digits": "regexp_count(text, r'[0-9]')",
    "lines": f"size({_SPARK_LINES})", "distinct_lines": f"size(array_distinct({_SPARK_LINES}))",
    "distinct_words": r"size(array_distinct(split(trim(BOTH r' ' FROM text), r'[ \t\n\r\f]+')))",
}
_DUCK = {
    "words": f"length(regexp_extract_all(text, '{WORD}'))", "symbols": f"length(regexp_extract_all(text, '{SYMBOL}'))", "upper": r"length(regexp_extract_all(text, '\p{Lu}'))", "digits": "length(regexp_extract_all(text, '[0-9]'))",
    "lines": f"len({_DUCK_LINES})", "distinct_lines": f"len(list_distinct({_DUCK_LINES}))",
    "distinct_words": r"len(list_distinct(regexp_split_to_array(trim(text, ' '), '[ \t\n\r\f]+')))",
}


def rule_column(rule: Rule, text: str) -> Column:
    """The rule over the column ``text`` of any name."""
    quoted = "`" + text.replace("`", "``") + "`"
    return F.expr(rule.when.format(**{k: v.replace("(text", f"({quoted}").replace("FROM text", f"FROM {quoted}") for k, v in _SPARK.items()}).replace("length(text)", f"length({quoted})"))


def rule_sql(rule: Rule) -> str:
    return rule.when.format(**_DUCK)


def plan_cascade(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """Rules with their cost (seconds on the sample) and share rejected there, the best rejection per cost first."""
    texts = docs.select(col(text_col).cast("string").alias("text")).where(F.length("text") <= SAMPLE_CHARS)
    # take() runs over a partition, then over more of them until it has the rows: no shuffle, and no pass over all
    rows = texts.sample(SAMPLE_SHARE, 7).take(sample_rows)
    sample = docs.sparkSession.createDataFrame(rows, "text string").coalesce(1).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = max(1, sample.count())

        def run(what: Column) -> tuple[float, float]:
            best, hit = float("inf"), 0
            for _ in range(2):
                at = time.perf_counter()
                hit = sample.agg(F.sum(what)).first()[0] or 0
                best = min(best, time.perf_counter() - at)
            return best, hit

        least, _ = run(F.length("text"))
        out = []
        for r in rules:
            took, hit = run(rule_column(r, "text").cast("long"))
            out.append((r, max(took - least, 1e-4), hit / n))
    finally:
        sample.unpersist()
    return sorted(out, key=lambda x: (-x[2] / x[1], x[0].name))


def judge(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, names: tuple[str, str] = ("kept", "reason")) -> DataFrame:
    """``docs`` with kept (boolean) and reason: the first rule of ``rules`` that rejects the text, null for a kept one.

    A narrow pass. The reason is worked out for rejected texts only.
    """
    order = [r for r, _, _ in plan_cascade(docs, text_col, rules)]
    text, = fresh(docs, "__text")
    df = docs.withColumn(text, F.coalesce(col(text_col).cast("string"), F.lit("")))
    rejects = F.when(rule_column(order[0], text), F.lit(True))
    for r in order[1:]:
        rejects = rejects.when(rule_column(r, text), F.lit(True))
    why = F.when(rule_column(rules[0], text), F.lit(rules[0].name))
    for r in rules[1:]:
        why = why.when(rule_column(r, text), F.lit(r.name))
    return df.withColumn(names[0], ~rejects.otherwise(F.lit(False))).withColumn(names[1], F.when(~F.col(names[0]), why)).drop(text)


def keep_good(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with the same columns."""
    kept, reason = fresh(docs, "__kept", "__reason")
    return judge(docs, text_col, rules, (kept, reason)).where(F.col(kept)).select(*[col(c) for c in docs.columns])


def judge_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL for ``judge`` over documents: doc_id, kept, reason."""
    case = " ".join(f"WHEN {rule_sql(r)} THEN '{r.name}'" for r in rules)
    return f"SELECT doc_id, reason IS NULL AS kept, reason FROM (SELECT doc_id, CASE {case} END AS reason FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))"


def keep_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL for the documents kept."""
    return f"SELECT doc_id, lang, source, n_chars FROM (SELECT doc_id, lang, source, n_chars, coalesce(text, '') AS text FROM documents) WHERE NOT ({' OR '.join(f'({rule_sql(r)})' for r in rules)})"
