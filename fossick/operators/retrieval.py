"""Retrieval over lines: boolean searches, ranking of files, top lines, context windows and budgets.

A corpus is scanned once for all terms of a search: every predicate is a column of the line, and files are judged by
the maximum of their lines' predicates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fossick.functions.matching import any_of, literal, predicate
from fossick.functions.scoring import file_score, line_relevance


#: Positions of a list that are numbered together.
_RUN = 1 << 16


def search_or(lines: DataFrame, terms: list[str], *, mode: str = "literal", case_sensitive: bool = False) -> DataFrame:
    """(path, line_number, line, term): a line once for each term that it matches; for ``regex`` once in all."""
    if mode == "regex":
        joined = "|".join(f"(?:{t})" for t in terms)
        return lines.where(predicate(F.col("line"), joined, mode="regex", case_sensitive=case_sensitive)).select("path", "line_number", "line", F.lit(joined).alias("term"))
    hits = F.filter(F.array(*[F.when(predicate(F.col("line"), t, mode=mode, case_sensitive=case_sensitive), F.lit(t)) for t in terms]), lambda x: x.isNotNull())
    return lines.where(any_of(F.col("line"), terms, case_sensitive=case_sensitive)).select("path", "line_number", "line", F.explode(hits).alias("term"))


def search_and(lines: DataFrame, terms: list[str], *, mode: str = "literal", case_sensitive: bool = False) -> DataFrame:
    """(path, line_number, line): lines with the last term, in files that hold every term."""
    p = [predicate(F.col("line"), t, mode=mode, case_sensitive=case_sensitive) for t in terms]
    marked = lines.select("path", "line_number", "line", *[x.alias(f"p{i}") for i, x in enumerate(p)]).where(F.greatest(*[F.col(f"p{i}") for i in range(len(p))], F.lit(False)))
    w = Window.partitionBy("path")
    every = [F.max(f"p{i}").over(w) for i in range(len(p))]
    ok = every[0]
    for e in every[1:]:
        ok = ok & e
    return marked.withColumn("ok", ok).where(F.col("ok") & F.col(f"p{len(p) - 1}")).select("path", "line_number", "line")


def search_same_line(lines: DataFrame, terms: list[str], *, case_sensitive: bool = False) -> DataFrame:
    """Lines that hold every term."""
    for t in terms:
        lines = lines.where(literal(F.col("line"), t, case_sensitive))
    return lines.select("path", "line_number", "line")


def search_not(lines: DataFrame, positive: str, negatives: list[str], *, mode: str = "literal", case_sensitive: bool = False) -> DataFrame:
    """Lines with ``positive`` in files without any of ``negatives``."""
    bad = lines.where(F.greatest(*[predicate(F.col("line"), t, mode=mode, case_sensitive=case_sensitive) for t in negatives], F.lit(False))).select("path").distinct()
    return lines.where(predicate(F.col("line"), positive, mode=mode, case_sensitive=case_sensitive)).join(bad, "path", "left_anti").select("path", "line_number", "line")


def search_inverted(lines: DataFrame, term: str, **how) -> DataFrame:
    return lines.where(~predicate(F.col("line"), term, **how)).select("path", "line_number", "line")


def count_matches(matches: DataFrame) -> DataFrame:
    """(path, n_matches) of files with a match."""
    return matches.groupBy("path").agg(F.count("*").alias("n_matches"))


def replace_preview(lines: DataFrame, pattern: str, replacement: str) -> DataFrame:
    """Matching lines with what a replacement would make of them."""
    return lines.where(F.col("line").rlike(pattern)).select("path", "line_number", F.regexp_replace("line", pattern, replacement).alias("line"))


def keyword_tf(lines: DataFrame, keywords: list[str]) -> DataFrame:
    """(path, tf0, tf1, ...): matching lines of each keyword, for files with any."""
    p = [literal(F.col("line"), k) for k in keywords]
    return lines.where(F.greatest(*p, F.lit(False))).groupBy("path").agg(*[F.sum(x.cast("int")).alias(f"tf{i}") for i, x in enumerate(p)])


def rank_files(lines: DataFrame, keywords: list[str], idf: dict[str, float] | None = None) -> DataFrame:
    """(path, n_lines, score): files by the sum of idf * (1 + ln tf) over the keywords."""
    tf = keyword_tf(lines, keywords)
    n = sum((F.col(f"tf{i}") for i in range(len(keywords))), F.lit(0))
    return tf.select("path", n.cast("bigint").alias("n_lines"), file_score({k: F.col(f"tf{i}") for i, k in enumerate(keywords)}, idf).alias("score"))


def prune(ranked: DataFrame, *, top_k: int = 5, floor: float = 0.30, gap: float = 0.50) -> DataFrame:
    """The best of (path, score): at least ``floor`` of the best score, up to the first relative drop of more than
    ``gap`` between neighbours, at least one, at most ``top_k``.

    The best ``top_k`` decide alone: a row's fate depends only on better ones. So no window runs over all files.
    """
    # one more than asked for isn't needed: a cut behind the last row changes nothing
    best = ranked.orderBy(F.desc("score"), "path").limit(top_k)
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "path")
    top, before = F.first("score").over(w), F.lag("score").over(w)
    marked = best.withColumn("rank", F.row_number().over(w)).withColumn("cut", (F.coalesce(F.col("score") < floor * top, F.lit(False)) | F.coalesce((before > 0) & ((before - F.col("score")) / before > gap), F.lit(False))).cast("int"))
    return marked.withColumn("cuts", F.max("cut").over(w.rowsBetween(Window.unboundedPreceding, 0))).where((F.col("cuts") == 0) | (F.col("rank") == 1)).drop("cut", "cuts")


def top_lines(matches: DataFrame, terms: list[str], n: int, **how) -> DataFrame:
    """(path, line_number, line, score, rank): the ``n`` most relevant lines of each file."""
    w = Window.partitionBy("path").orderBy(F.desc("score"), "line_number")
    return matches.withColumn("score", F.round(line_relevance(F.col("line"), terms, **how), 6)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("path", "line_number", "line", "score", "rank")


def files_of_matches(matches: DataFrame, terms: list[str], n: int = 20) -> DataFrame:
    """(path, total_matches, total_score, lines): one row a file, with its ``n`` best lines in order of score."""
    w = Window.partitionBy("path").orderBy(F.desc("score"), "line_number")
    scored = matches.withColumn("score", line_relevance(F.col("line"), terms)).withColumn("rank", F.row_number().over(w))
    kept = F.when(F.col("rank") <= n, F.struct("rank", "line"))
    return scored.groupBy("path").agg(F.count("*").alias("total_matches"), F.sum("score").alias("total_score"), F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["line"]).alias("lines"))


def diverse_lines(matches: DataFrame, terms: list[str], n: int = 5) -> DataFrame:
    """(path, term, line_number, line, place): the best line of each keyword in turn, equal lines once, ``n`` a file."""
    scored = matches.withColumn("score", F.round(line_relevance(F.col("line"), terms), 6))
    once = scored.withColumn("r", F.row_number().over(Window.partitionBy("path", "line").orderBy(F.desc("score"), "line_number", "term"))).where("r = 1")
    turn = once.withColumn("turn", F.row_number().over(Window.partitionBy("path", "term").orderBy(F.desc("score"), "line_number")))
    at = F.array_position(F.array(*map(F.lit, terms)), F.col("term"))
    return turn.withColumn("place", F.row_number().over(Window.partitionBy("path").orderBy("turn", at, "line_number"))).where(F.col("place") <= n).select("path", "term", "line_number", "line", "place")


def context_windows(hits: DataFrame, *, window: int = 30, few_window: int = 100, few: int = 2) -> DataFrame:
    """(path, first_line, last_line): windows around hit lines (path, line_number), merged where they touch."""
    per = Window.partitionBy("path")
    w = F.when(F.count("*").over(per) <= few, few_window).otherwise(window)
    spans = hits.select("path", "line_number").distinct().withColumn("w", w).select("path", F.greatest(F.lit(1), F.col("line_number") - F.col("w")).alias("a"), (F.col("line_number") + F.col("w")).alias("b"))
    order = per.orderBy("a", "b")
    far = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = spans.withColumn("new", F.coalesce((F.col("a") > far + 1).cast("int"), F.lit(1)))
    island = F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return new.withColumn("island", island).groupBy("path", "island").agg(F.min("a").alias("first_line"), F.max("b").alias("last_line")).drop("island")


def read_windows(windows: DataFrame, lines: DataFrame) -> DataFrame:
    """(path, first_line, last_line, n_lines, content): the windows' text; they may reach beyond the file."""
    w, x = windows.alias("w"), lines.alias("x")
    joined = w.join(x, (F.col("w.path") == F.col("x.path")) & F.col("x.line_number").between(F.col("w.first_line"), F.col("w.last_line")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x.line_number", "x.line"))), lambda s: s["line"]), "\n")
    return joined.groupBy("w.path", "w.first_line", "w.last_line").agg(F.count("*").alias("n_lines"), text.alias("content"))


def char_budget(pieces: DataFrame, order: list, *, budget: int = 15_000, least: int = 200, by: list[str] | None = None) -> DataFrame:
    """Pieces with ``content`` taken in order until ``budget`` characters: the piece that crosses it is cut, if more
    than ``least`` characters are left for it, and nothing follows."""
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    left = budget - F.coalesce(F.sum(F.length("content")).over(w), F.lit(0))
    out = pieces.withColumn("_left", left).where((F.length("content") <= F.col("_left")) | (F.col("_left") > least))
    return out.withColumn("content", F.substring(F.col("content"), F.lit(1), F.col("_left").cast("int"))).drop("_left")


def union_in_order(*paths: DataFrame, most: int | None = None) -> DataFrame:
    """(path, place) of several lists (path, pos): each path at its first occurrence, earlier lists first; the first
    ``most`` if given.

    Places are counted inside runs of ``_RUN`` positions of a list and added up over the runs, so no task numbers all.
    """
    both = None
    for i, p in enumerate(paths):
        one = p.select("path", F.struct(F.lit(i).alias("list"), F.col("pos").cast("bigint").alias("pos")).alias("at"))
        both = one if both is None else both.unionAll(one)
    first = both.groupBy("path").agg(F.min("at").alias("at")).select("path", "at.list", "at.pos")
    if most is not None:
        few = first.orderBy("list", "pos", "path").limit(most)
        return few.select("path", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("list", "pos", "path")).alias("place"))
    first = first.withColumn("run", F.floor(F.col("pos") / _RUN))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("list", "run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = first.groupBy("list", "run").agg(F.count("*").alias("n")).select("list", "run", ahead.alias("ahead"))
    inside = F.row_number().over(Window.partitionBy("list", "run").orderBy("pos", "path"))
    return first.withColumn("inside", inside).join(runs, ["list", "run"]).select("path", (F.col("inside") + F.col("ahead")).cast("int").alias("place"))


def filename_search(files: DataFrame, patterns: list[str], *, case_sensitive: bool = False, globs: bool = False) -> DataFrame:
    """(path, filename, matched_pattern, match_score): the first pattern that a name matches counts.

    ``globs``: the patterns are globs for the whole name. Else a pattern that is no regular expression is read as a
    glob if it looks like one, and skipped otherwise.
    """
    import re

    from fossick.functions.matching import glob_pattern, is_glob, regex
    from fossick.functions.scoring import filename_score

    which, score = None, None
    for p in patterns:
        pattern = glob_pattern(p) if globs else p
        try:
            re.compile(pattern)
        except re.error:
            if not is_glob(p):
                continue
            pattern = glob_pattern(p)
        ok = regex(F.col("filename"), pattern, case_sensitive)
        which = F.when(ok, F.lit(p)) if which is None else which.when(ok, F.lit(p))
        s = filename_score(F.col("filename"), p, case_sensitive)
        score = F.when(ok, s) if score is None else score.when(ok, s)
    if which is None:
        return files.where(F.lit(False)).select("path", "filename", F.lit("").alias("matched_pattern"), F.lit(0.0).alias("match_score"))
    return files.select("path", "filename", which.alias("matched_pattern"), score.alias("match_score")).where("matched_pattern IS NOT NULL")


def share_counts(counts: DataFrame, n_keywords: int) -> Column:
    """Matches of one alternation, shared out to its keywords: at least one each."""
    return F.greatest(F.lit(1), F.expr(f"n_matches div {n_keywords}"))
