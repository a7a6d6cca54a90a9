"""The three searches: by file name, fast (keyword ranking) and deep (several probes, evidence, a cluster).

A language model is any object with the methods of ``Model``; ``PlainModel`` needs none: it takes the query's words as
keywords and the evidence as the answer. Only a handful of ranked paths and texts within the budget reach the driver.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fossick.functions.matching import any_of, is_glob
from fossick.functions.scoring import default_idf
from fossick.operators import evidence as ev
from fossick.operators import files as fs
from fossick.operators import knowledge, retrieval

GREETING = re.compile(r"^\s*(hi|hello|hey|thanks|thank you|bye|who are you|hola|bonjour|salut|hallo|danke|merci|gracias)\b[\s!.?]*$", re.I)


@dataclass(frozen=True)
class Config:
    top_k_files: int = 5
    max_depth: int = 5
    char_budget: int = 15_000
    whole_file: int = 100_000
    reuse_threshold: float = 0.85
    reuse_top_k: int = 3
    queries_kept: int = 5
    roots: tuple[str, ...] = ("/corpus",)


class Model(Protocol):
    def keywords(self, query: str) -> tuple[dict[str, float], dict[str, float]]:
        """Primary and fallback keywords with their weights."""

    def answer(self, query: str, context: str) -> tuple[str, bool]:
        """The answer, and whether it is worth keeping."""


class PlainModel:
    def keywords(self, query: str) -> tuple[dict[str, float], dict[str, float]]:
        words = list(dict.fromkeys(w for w in re.findall(r"\w+", query.lower()) if len(w) > 2))
        first = sorted(words, key=lambda w: -len(w))
        return {w: default_idf(w) for w in first[:2]}, {w: default_idf(w) for w in first[2:5]}

    def answer(self, query: str, context: str) -> tuple[str, bool]:
        return context, bool(context)


@dataclass
class Answer:
    text: str
    paths: list[str] = field(default_factory=list)
    cluster: DataFrame | None = None


def by_filename(files: DataFrame, query: str, *, top_k: int = 20) -> DataFrame:
    """(path, filename, matched_pattern, match_score): a glob as it stands, else any of the query's words."""
    glob = is_glob(query)
    patterns = [query] if glob else [f".*{re.escape(w)}.*" for w in query.split()]
    return retrieval.filename_search(files, patterns, globs=glob).orderBy(F.desc("match_score"), "path").limit(top_k)


def rank(lines: DataFrame, files: DataFrame, primary: dict[str, float], fallback: dict[str, float], config: Config) -> tuple[DataFrame, list[str]]:
    """Ranked and pruned (path, score, rank) by the first of: primary keywords, fallback keywords, file names.

    The ``top_k_files`` rows come to the driver, so that what uses them doesn't rank again.
    """
    every = {**primary, **fallback}
    for words in (primary, fallback):
        if words:
            rows = retrieval.prune(retrieval.rank_files(lines, list(words), words).select("path", "score"), top_k=config.top_k_files).collect()
            if rows:
                return files.sparkSession.createDataFrame([(r.path, r.score, r["rank"]) for r in rows], "path string, score double, rank int"), list(words)
    names = by_filename(files, " ".join(every) or " ", top_k=1).collect()
    return files.sparkSession.createDataFrame([(r.path, 0.0, 1) for r in names], "path string, score double, rank int"), list(every)


def gather(ranked: DataFrame, files: DataFrame, lines: DataFrame, words: list[str], config: Config) -> DataFrame:
    """(path, rank, first_line, content) within the budget: short files whole, others as windows around their hits."""
    few = F.broadcast(ranked.select("path", "rank"))  # at most ``top_k_files`` rows
    chosen = files.join(few, "path")
    whole = chosen.where(F.length("content") < config.whole_file).select("path", "rank", F.lit(1).alias("first_line"), "content")
    long = lines.join(F.broadcast(chosen.where(F.length("content") >= config.whole_file).select("path", "rank")), "path")
    spans = retrieval.context_windows(long.where(any_of(F.col("line"), words)).select("path", "line_number"))
    cut = retrieval.read_windows(spans, long).join(few, "path").select("path", "rank", "first_line", "content")
    return retrieval.char_budget(whole.unionByName(cut), ["rank", "first_line"], budget=config.char_budget)


def fast(files: DataFrame, lines: DataFrame, query: str, *, model: Model | None = None, config: Config = Config()) -> Answer:
    model = model or PlainModel()
    if GREETING.match(query):
        return Answer("")
    primary, fallback = model.keywords(query)
    ranked, words = rank(lines, files, primary, fallback, config)
    got = gather(ranked, files, lines, words, config).orderBy("rank", "first_line").collect()
    context = "\n\n".join(f"[{r.path}]\n{r.content}" for r in got)
    text, keep = model.answer(query, context)
    paths = list(dict.fromkeys(r.path for r in got))
    return Answer(text, paths, new_cluster(files.sparkSession, query, text, paths) if keep and paths else None)


def new_cluster(spark, query: str, text: str, paths: list[str]) -> DataFrame:
    """One cluster of a query's answer: EMERGING, confidence, hotness and landmark potential 0.5, version 1."""
    row = spark.createDataFrame([(query, text, paths)], "query string, content string, files array<string>")
    evidence = F.transform("files", lambda f: F.struct(F.substring(F.sha2(f, 256), 1, 12).alias("doc_id"), f.alias("file"), F.lit(True).alias("is_found")))
    return row.select(
        knowledge.query_id(F.col("query")).alias("id"), F.substring("query", 1, 60).alias("name"), F.array(F.substring("content", 1, 200)).alias("description"), "content", evidence.alias("evidences"), F.array("query").alias("queries"),
        F.lit("EMERGING").alias("lifecycle"), F.lit("TECHNIQUE").alias("abstraction_level"), F.lit(0.5).alias("confidence"), F.lit(0.5).alias("hotness"), F.lit(0.5).alias("landmark_potential"), F.lit(1).alias("version"),
    )


def deep(files: DataFrame, lines: DataFrame, query: str, *, clusters: DataFrame | None = None, model: Model | None = None, config: Config = Config()) -> Answer:
    """Keyword hits, files of known clusters and file hints joined in this order; evidence of each; an answer."""
    model = model or PlainModel()
    primary, fallback = model.keywords(query)
    words = list({**primary, **fallback})
    keyword = retrieval.rank_files(lines, words).orderBy(F.desc("score"), "path").limit(config.top_k_files)
    lists = [keyword.select("path", (-F.col("score") * 1_000_000).cast("bigint").alias("pos"))]
    if clusters is not None:
        hit = knowledge.still_there(knowledge.find(clusters, query).join(clusters.select("id", "evidences"), "id"), files)
        lists.append(hit.select(F.col("file").alias("path"), F.lit(0).alias("pos")))
    hints = files.sparkSession.createDataFrame([(w,) for w in words], "hint string")
    lists.append(fs.resolve_hints(files, hints).select("path", F.col("place").alias("pos")))
    rows = retrieval.union_in_order(*lists, most=config.top_k_files).collect()
    paths = F.broadcast(files.sparkSession.createDataFrame([(r.path, r.place) for r in rows], "path string, place int"))  # ``top_k_files`` rows
    chosen = files.join(paths, "path")
    found = ev.evidence(chosen, words, whole=config.whole_file).where("is_found").select("path", "start", "end")
    # a long file gives its best windows and what stands around them, a short one all of it
    long = ev.fragments(found, chosen.where(F.length("content") >= config.whole_file)).withColumnRenamed("context", "content")
    short = chosen.where(F.length("content") < config.whole_file).join(found.select("path").distinct(), "path", "left_semi").select("path", "content")
    rows = retrieval.char_budget(long.unionByName(short).join(paths, "path"), ["place"], budget=config.char_budget).orderBy("place").collect()
    text, keep = model.answer(query, "\n\n".join(f"[{r.path}]\n{r.content}" for r in rows))
    used = list(dict.fromkeys(r.path for r in rows))
    return Answer(text, used, new_cluster(files.sparkSession, query, text, used) if keep and used else None)


def search(files: DataFrame, lines: DataFrame, query: str, *, mode: str = "FAST", **options) -> Answer | DataFrame:
    if mode == "FILENAME_ONLY":
        return by_filename(files, query)
    return {"FAST": fast, "DEEP": deep}[mode](files, lines, query, **options)
