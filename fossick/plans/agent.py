"""An agent that searches by calling tools: it reads a model's replies, calls what they ask for and ends with an answer.

The model is any function from messages to a reply and the tokens it took. Tools are those of ``plans.tools``; what
they return to the model is bounded in rows and characters, so nothing that grows with the corpus reaches the driver.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fossick.functions.scoring import line_relevance
from fossick.operators import files as fs
from fossick.operators import scan
from fossick.plans.tools import Registry, Tool

Chat = Callable[[list[dict[str, str]]], tuple[str, int]]
#: What a call's arguments may be called.
_ARGUMENTS = ("arguments", "args", "parameters")


def answer_in(reply: str) -> str | None:
    """What stands between the answer tags; null without them or if it is blank."""
    m = re.search(r"<ANSWER>(.*?)</ANSWER>", reply, re.S)
    return (m.group(1).strip() or None) if m else None


def _objects(text: str):
    """Every JSON object that begins at a brace of the text, the outermost first; broken ones are passed over."""
    decode, at = json.JSONDecoder().raw_decode, 0
    while (at := text.find("{", at)) >= 0:
        try:
            value, end = decode(text, at)
            yield value, at, end
            at = end
        except ValueError:
            at += 1


def tool_call(reply: str, names: list[str]) -> tuple[str, dict] | None:
    """The first call of a known tool in a reply: an object with ``tool`` or ``name`` and its arguments, in a code block
    before anywhere else, or the form ``name({...})``."""
    blocks = re.findall(r"```(?:json)?\s*(.*?)```", reply, re.S)
    for text in (*blocks, reply):
        for value, _, _ in _objects(text):
            name = value.get("tool") or value.get("name")
            if name in names:
                given = next((value[k] for k in _ARGUMENTS if value.get(k)), {})
                return name, given if isinstance(given, dict) else {}
    calls = ((m.group(1), value) for value, at, end in _objects(reply) if (m := re.search(r"(\w+)\s*\(\s*$", reply[:at])) and re.match(r"\s*\)", reply[end:]))
    return next(((name, value) for name, value in calls if name in names), None)


@dataclass
class Session:
    """What a run did: turns, tokens, the tools called with their rows, and the reply it ended with."""

    max_turns: int = 10
    max_tokens: int = 64_000
    turns: int = 0
    tokens: int = 0
    calls: list[tuple[str, dict, int]] = field(default_factory=list)
    answer: str = ""
    forced: bool = False

    @property
    def over(self) -> bool:
        return self.turns >= self.max_turns or self.tokens >= self.max_tokens


def _shown(rows: list[dict], error: str, most: int) -> str:
    text = error or "\n".join(json.dumps(r, ensure_ascii=False, default=str) for r in rows) or "No results"
    return text if len(text) <= most else text[:most] + "\n[cut]"


def run(chat: Chat, tools: Registry, query: str, *, keywords: list[str] | None = None, max_turns: int = 10, max_tokens: int = 64_000, max_chars: int = 8000) -> Session:
    """Asks the model until it answers, at most ``max_turns`` times and ``max_tokens`` tokens; then once more for the best
    answer from what there is. A reply that neither calls nor answers is told so. ``keywords`` are searched before the
    first turn, which counts as one."""
    s = Session(max_turns, max_tokens)
    names = list(tools.tools)
    about = "; ".join(f"{t.name}({', '.join(t.arguments)})" for t in tools.tools.values())
    say = lambda role, content: messages.append({"role": role, "content": content})
    messages: list[dict[str, str]] = []
    say("system", f'Answer by searching. Tools: {about}. Call one as {{"tool": name, "arguments": {{...}}}}, or answer in <ANSWER> tags.')
    say("user", query)

    def left() -> str:
        return f"{s.max_turns - s.turns} turns and {max(0, s.max_tokens - s.tokens)} tokens are left."

    def call(name: str, given: dict) -> None:
        rows, error = tools.call(name, **given)
        s.calls.append((name, given, len(rows)))
        if rows or error or name != "keyword_search" or s.turns > 1:
            say("user", f"{name} gave:\n{_shown(rows, error, max_chars)}\n{left()}")

    def ask() -> str:
        reply, n = chat(messages)
        s.tokens += n
        say("assistant", reply)
        return reply

    if keywords and "keyword_search" in names:
        s.turns += 1
        call("keyword_search", {"keywords": keywords})
    while not s.over:
        s.turns += 1
        reply = ask()
        if answer := answer_in(reply):
            s.answer = answer
            return s
        wanted = tool_call(reply, names)
        if wanted is None:
            say("user", f"That was neither a call nor an answer in <ANSWER> tags. {left()}")
        else:
            call(*wanted)
    say("user", "The search has to end here. Give the best answer that the results allow, in <ANSWER> tags.")
    reply = ask()
    s.answer, s.forced = answer_in(reply) or reply.strip(), True
    return s


def by_words(candidates: DataFrame, query: str, top_k: int = 20) -> DataFrame:
    """(path, relevance, reason, place): a ranker without a model, by the query's words in title, keywords and preview.

    Of the best ``top_k``: high from half of the best score on, medium from a fifth on, else low."""
    words = [w for w in dict.fromkeys(re.findall(r"\w+", query.lower())) if len(w) > 2]
    text = F.concat_ws(" ", "title", "title", F.array_join("keywords", " "), "preview")
    score = line_relevance(text, words, length_norm="none") if words else F.lit(0.0)
    best = candidates.select("path", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "path").limit(top_k)
    top = best.agg(F.max("score").alias("top"))
    level = F.when(F.col("score") >= 0.5 * F.col("top"), "high").when(F.col("score") >= 0.2 * F.col("top"), "medium").otherwise("low")
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "path"))  # of top_k rows
    return best.join(F.broadcast(top)).select("path", level.alias("relevance"), F.lit("words of the query").alias("reason"), place.alias("place"))


def by_model(chat: Chat, candidates: DataFrame, query: str, top_k: int = 20, seed: int = 0) -> DataFrame:
    """(path, relevance, reason, place): a model judges ``top_k`` candidates, random ones if there are more; a reply that
    can't be read leaves all of them unjudged, as low."""
    some = scan.sample(candidates, top_k, seed)
    root = fs.common_root(some).first()["root"] or "/"
    rows = some.select("path", "title", "preview").orderBy("path").collect()
    listing = "\n\n".join(f"- {r.path.removeprefix(root.rstrip('/') + '/')}\n  {r.title}\n  {r.preview[:300]}" for r in rows)
    reply, _ = chat([{"role": "user", "content": f'Query: {query}\n\nFiles:\n{listing}\n\nGive a JSON list of {{"path": ..., "relevance": "high", "medium" or "low", "reason": ...}}.'}])
    spark = candidates.sparkSession
    one = spark.createDataFrame([(reply,)], "reply string").select(F.posexplode(scan.reply_entries(F.col("reply"))).alias("pos", "e"))
    named = one.select("pos", F.col("e.path").alias("named"), F.col("e.relevance").alias("relevance"), F.col("e.reason").alias("reason"))
    if not named.limit(1).count():
        named = spark.createDataFrame([(i, r.path, "low", "") for i, r in enumerate(rows)], "pos int, named string, relevance string, reason string")
    return scan.ranked(named, candidates)


def add_scan(tools: Registry, files: DataFrame, root: str, *, chat: Chat | None = None, max_files: int = 500) -> None:
    """Adds ``dir_scan(query, top_k)``: the candidates of a scan, made once and kept, ranked for the query."""
    kept: list[DataFrame] = []

    def dir_scan(query: str, top_k: int = 20) -> DataFrame:
        if not kept:
            kept.append(scan.candidates(scan.walk(files, root, max_files=max_files)).cache())
        found = by_model(chat, kept[0], query, top_k) if chat else by_words(kept[0], query, top_k)
        return found.join(kept[0].select("path", "title", "size_bytes"), "path").orderBy("place")

    tools.add(Tool("dir_scan", ("query", "top_k"), dir_scan))
