"""Tools that an agent may call: a name, what it takes, and a function to rows; errors come back as text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fossick.operators import knowledge, retrieval


@dataclass(frozen=True)
class Tool:
    name: str
    arguments: tuple[str, ...]
    run: Callable[..., DataFrame]


@dataclass
class Registry:
    tools: dict[str, Tool] = field(default_factory=dict)
    read: set[str] = field(default_factory=set)

    def add(self, tool: Tool) -> None:
        self.tools[tool.name] = tool

    def call(self, name: str, *, rows: int = 50, **arguments) -> tuple[list[dict], str]:
        """At most ``rows`` rows that a model gets to see, and what went wrong, if anything did."""
        tool = self.tools.get(name)
        if tool is None:
            return [], f"no tool {name}; there are {', '.join(sorted(self.tools))}"
        if unknown := set(arguments) - set(tool.arguments):
            return [], f"{name} doesn't take {', '.join(sorted(unknown))}"
        try:
            return [r.asDict(recursive=True) for r in tool.run(**arguments).limit(rows).collect()], ""
        except Exception as e:  # noqa: BLE001 a model is told of any error
            return [], f"{type(e).__name__}: {str(e)[:300]}"


def standard(files: DataFrame, lines: DataFrame, clusters: DataFrame | None = None, *, most_chars: int = 30_000) -> Registry:
    """Keyword search, file reading (each file once) and cluster lookup."""
    reg = Registry()

    def keyword_search(keywords: list[str]) -> DataFrame:
        return retrieval.diverse_lines(retrieval.search_or(lines, keywords), keywords).orderBy("path", "place")

    def file_read(paths: list[str]) -> DataFrame:
        new = [p for p in dict.fromkeys(paths) if p not in reg.read]
        reg.read.update(new)
        return files.where(F.col("path").isin(new)).select("path", F.substring("content", 1, most_chars).alias("content"))

    reg.add(Tool("keyword_search", ("keywords",), keyword_search))
    reg.add(Tool("file_read", ("paths",), file_read))
    if clusters is not None:
        reg.add(Tool("knowledge_query", ("query", "limit"), lambda query, limit=10: knowledge.find(clusters, query, limit)))
    return reg
