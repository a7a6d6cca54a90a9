"""Text functions as columns: tags, JSON salvage, samples, chunks, metadata, noise lines, paths, sizes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_OFFICE = "application/vnd.openxmlformats-officedocument."
MIME = {
    "txt": "text/plain", "log": "text/plain", "md": "text/markdown", "rst": "text/x-rst", "csv": "text/csv", "tsv": "text/tab-separated-values", "json": "application/json", "html": "text/html", "htm": "text/html",
    "css": "text/css", "js": "text/javascript", "py": "text/x-python", "sh": "application/x-sh", "xml": "application/xml", "yaml": "application/yaml", "yml": "application/yaml", "toml": "application/toml", "pdf": "application/pdf",
    "docx": _OFFICE + "wordprocessingml.document", "xlsx": _OFFICE + "spreadsheetml.sheet", "pptx": _OFFICE + "presentationml.presentation", "doc": "application/msword", "xls": "application/vnd.ms-excel",
    "ppt": "application/vnd.ms-powerpoint", "zip": "application/zip", "gz": "application/gzip", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "svg": "image/svg+xml", "mp3": "audio/mpeg", "mp4": "video/mp4",
}


# --- replies of a language model


def tag_field(text: Column, tag: str) -> Column:
    """What stands in ``<tag>...</tag>``, over lines, trimmed; null where the tag is absent."""
    t = re.escape(tag)
    return F.when(text.rlike(f"(?s)<{t}>.*?</{t}>"), F.btrim(F.regexp_extract(text, f"(?s)<{t}>(.*?)</{t}>", 1), F.lit(" \t\r\n")))


def truthy(text: Column) -> Column:
    return F.coalesce(F.lower(text).isin("true", "yes", "1"), F.lit(False))


def summary_decision(reply: Column) -> Column:
    """struct(summary, should_answer, should_save) of a tagged reply.

    Without a summary the whole reply stands for it and both flags are false, whatever the other tags say.
    """
    summary = F.coalesce(tag_field(reply, "SUMMARY"), F.lit(""))
    some = summary != ""
    return F.struct(
        F.when(some, summary).otherwise(F.btrim(reply, F.lit(" \t\r\n"))).alias("summary"), (some & truthy(tag_field(reply, "SHOULD_ANSWER"))).alias("should_answer"),
        (some & truthy(tag_field(reply, "SHOULD_SAVE"))).alias("should_save"),
    )


def salvage_json(reply: Column) -> Column:
    """The JSON of a reply as a variant: the whole, without code fences, the outermost object, an inner flat one."""
    bare = F.regexp_replace(F.trim(reply), r"(?s)^```[a-zA-Z]*\s*|\s*```$", "")
    return F.coalesce(F.try_parse_json(reply), F.try_parse_json(bare), F.try_parse_json(F.regexp_extract(reply, r"(?s)\{.*\}", 0)), F.try_parse_json(F.regexp_extract(reply, r"(?s)\{[^{}]*\}", 0)))


def salvage_score(reply: Column) -> Column:
    """A score in a reply, from its JSON or else from ``score: 7.5``; null where there is none."""
    from_json = F.try_variant_get(salvage_json(reply), "$.score", "double")
    return F.coalesce(from_json, F.regexp_extract(reply, r"(?i)\"?score\"?\s*[:=]\s*([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double"))


def keyword_map(reply: Column) -> Column:
    """keyword -> weight from a JSON object or one with single quotes, weights between 1 and 10."""
    body = F.regexp_extract(reply, r"(?s)\{[^{}]*\}", 0)
    parse = lambda c: F.from_json(c, "map<string,double>")
    m = F.coalesce(parse(body), parse(F.replace(body, F.lit("'"), F.lit('"'))))
    return F.transform_values(F.map_filter(m, lambda _, v: v.isNotNull()), lambda _, v: F.least(F.lit(10.0), F.greatest(F.lit(1.0), v)))


# --- samples and chunks


def head_middle_tail(text: Column, most: int, mark: str = "[...content sampled...]") -> Column:
    """A text of more than ``most`` characters as its first 40 per cent of ``most``, as many around its centre and the
    last 20, the marks between them on lines of their own. What the ends hold isn't repeated in the middle."""
    head, tail = int(most * 0.4), int(most * 0.2)
    mid = most - head - tail
    n = F.length(text)
    begin = F.floor(n / 2).cast("int") - mid // 2
    end = F.least(begin + mid, n - tail)
    begin = F.greatest(begin, F.lit(head))
    middle = F.substring(text, begin + 1, F.greatest(F.lit(0), end - begin))
    parts = [F.substring(text, 1, head), F.when(end > begin, F.concat(F.lit(mark + "\n"), middle)), F.lit(mark)]
    if tail:
        parts.append(F.substring(text, n - tail + 1, F.lit(tail)))
    return F.when(n <= most, text).otherwise(F.concat_ws("\n", *parts))


def chunks(text: Column, size: int) -> Column:
    """Consecutive pieces of ``size`` characters."""
    n = F.greatest(F.lit(1), F.ceil(F.length(text) / size)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * size + 1, F.lit(size)))


def windows(text: Column, size: int = 500, stride: int = 250) -> Column:
    """array<struct<start, content>> of overlapping windows."""
    last = F.greatest(F.lit(0), F.length(text) - 1)
    return F.transform(F.sequence(F.lit(0), last.cast("int"), F.lit(stride)), lambda i: F.struct(i.alias("start"), F.substring(text, i + 1, F.lit(size)).alias("content")))


def expand(text: Column, start: Column, size: int = 500, by: int = 1000) -> Column:
    """A window with ``by`` characters on both sides."""
    lo = F.greatest(F.lit(0), start - by)
    return F.substring(text, lo + 1, start + size + by - lo)


def estimated_tokens(text: Column, per: float = 3.5) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / F.lit(per)).cast("int"))


# --- metadata


def _head_lines(text: Column) -> Column:
    """Lines of the first 1300 characters without the blanks around them."""
    return F.transform(F.split(F.substring(text, 1, 1300), "\n"), lambda x: F.btrim(x, F.lit(" \t\r")))


def title_line(text: Column, most: int = 120) -> Column:
    """The first line of the first 1300 characters with more than two characters once leading hashes are gone; empty if
    there is none."""
    bare = F.transform(_head_lines(text), lambda x: F.btrim(F.regexp_replace(x, "^#+", ""), F.lit(" \t\r")))
    return F.substring(F.coalesce(F.try_element_at(F.filter(bare, lambda x: F.length(x) > 2), F.lit(1)), F.lit("")), 1, most)


def preview(text: Column, most: int = 800) -> Column:
    return F.btrim(F.substring(text, 1, most), F.lit(" \t\r\n"))


def estimated_lines(text: Column, size: Column) -> Column:
    """Newlines of the first 1300 characters, carried on from their bytes to the whole size."""
    head = F.substring(text, 1, 1300)
    n = F.octet_length(head)
    return F.when(n > 0, F.floor(F.regexp_count(head, F.lit("\n")) * (size / n))).otherwise(0).cast("bigint")


def head_keywords(text: Column, most: int = 10) -> Column:
    """Different words of more than three characters in the first ten lines, in order; lines of five characters or fewer
    are passed over."""
    long = F.filter(F.slice(_head_lines(text), 1, 10), lambda x: F.length(x) > 5)
    words = F.flatten(F.transform(long, lambda x: F.split(x, "[ \t\r]+")))
    bare = F.transform(words, lambda w: F.lower(F.btrim(w, F.lit(".,;:!?()[]{}\"'"))))
    return F.slice(F.array_distinct(F.filter(bare, lambda w: F.length(w) > 3)), 1, most)


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))


def mime_type(name: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])
    return F.coalesce(known[extension(name)], F.lit("application/octet-stream"))


def human_size(size: Column) -> Column:
    """1.5 KB and the like, one decimal above bytes; halves go to the even digit."""
    out = F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
    for i, unit in enumerate(("KB", "MB", "GB"), 1):
        out = out.when(size < 1024 ** (i + 1), F.format_string(f"%.1f {unit}", F.bround(size / float(1024**i), 1)))
    return out.otherwise(F.format_string("%.1f TB", F.bround(size / float(1024**4), 1)))


def iso_time(text: Column) -> Column:
    """A timestamp without zone, in UTC, from an ISO 8601 date or time with ``Z``, an offset or none; null for other texts."""
    whole = F.when(F.length(text) == 10, F.concat(text, F.lit("T00:00:00Z"))).when(text.rlike(r"(?:[Zz]|[+-]\d{2}:?\d{2})$"), text).otherwise(F.concat(text, F.lit("Z")))
    micros = F.unix_micros(F.try_to_timestamp(whole))
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (micros / F.lit(1_000_000)).cast("decimal(18,6)"))


def unix_seconds(at: Column) -> Column:
    """Whole seconds since 1970 of a timestamp without zone, taken as UTC."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), at)


def split_keywords(raw: Column) -> Column:
    return F.filter(F.transform(F.split(raw, "[,;|]"), lambda x: F.trim(x)), lambda x: x != "")


def safe_filename(name: Column) -> Column:
    """The last part of a path with odd characters replaced and leading dots gone; ``unnamed`` if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"^.*[/\\]", ""), r"[^\p{L}\p{N}._ -]", "_"), r"^\.+", "")
    return F.when(F.length(F.trim(s)) == 0, "unnamed").otherwise(F.trim(s))


def stem(name: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"(?<=.)\.[^.]*$", "")


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def highlight(name: Column, query: str) -> Column:
    """struct(start, end) of the query in a name, whatever the case; start is -1 where it is absent."""
    at = F.locate(query.lower(), F.lower(name)) - 1
    return F.struct(at.alias("start"), F.when(at >= 0, at + len(query)).otherwise(-1).alias("end"))


def is_valid_utf8(raw: Column) -> Column:
    return F.is_valid_utf8(raw)


def fingerprint(content: Column, size: Column) -> Column:
    """MD5 of up to 16 KiB, of a longer file its first and last 8 KiB, and the size."""
    part = F.when(size <= 16384, content).otherwise(F.concat(F.substring(content, 1, 8192), F.substring(content, -8192, 8192)))
    return F.concat(F.md5(part), F.lit("_"), size.cast("string"))


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def html_links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"""href="([^"]*)\""""), 1)


def html_text(html: Column) -> Column:
    """Text without scripts, styles, comments and tags, blanks squeezed."""
    bare = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "<[^>]*>", " "), r"[ \t\r\n]+", " "))


# --- lines that say little

#: A line that is markup and nothing else: rules, empty quotes and items, deep headings, images, references, fences, tables.
MARKUP = r"^\s*(?:(?:-{3,}|\*{3,}|_{3,}|>+|[-*+]|\d+\.)\s*|#{6,}.*|!\[.*\]\(.*\)\s*|\[.*\]:\s*https?://\S+\s*|(?:```|~~~)\s*\w*\s*|\|\s*[-:]+\s*\|\s*|\|(?:\s*:?-+:?\s*\|)+\s*)$"
#: What a line of small print begins with, or is, in lower case.
SMALL_PRINT = r"^(?:copyright|©|\(c\)|all rights reserved|confidential|page \d+|\d+\s+of\s+\d+$|(?:file|path|created|modified|author|version|build|toc):|generated by|this document|last updated|table of contents|contents|index)"
#: Links, addresses and lines of marks: what is left without them must say something.
LINKS = r"https?://\S+|\bwww\.\S+\b|\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z|]{2,}\b|^[\s*_=#+-]+$"


#: A line that begins with a letter and has three letters or digits for each four other characters, never three of those in
#: a row: it is no markup, not few letters and no mark over and over.
PLAIN = r"^(?=\p{L})(?:[\p{L}\p{N}]{2,}+[^\p{L}\p{N}]{0,2}+(?:[\p{L}\p{N}][^\p{L}\p{N}]{1,2}+)?+|[\p{L}\p{N}][^\p{L}\p{N}]?+)++$"


def is_noise(line: Column) -> Column:
    """Whether a line says little: fewer than ten characters, markup, small print, one character or mark over and over,
    few letters and digits, also once links and addresses are gone.

    Of a plain line without links only two of these can be, so only they are tried.
    """
    s = F.btrim(line, F.lit(" \t\r"))
    n = F.length(s)
    letters = lambda c: F.length(c) - F.length(F.regexp_replace(c, r"[\p{L}\p{N}]+", ""))
    markup = F.length(F.regexp_replace(s, r"[^#*_~`>!\[\](){}|:-]", ""))
    one = s.rlike(r"(.)\1{4}") & F.exists(F.regexp_extract_all(s, F.lit(r"(.)\1{4}"), 1), lambda c: n - F.length(F.replace(s, c, F.lit(""))) > 0.6 * n)
    small = F.lower(s).rlike(SMALL_PRINT)
    rest = F.btrim(F.regexp_replace(F.regexp_replace(s, LINKS, ""), MARKUP, ""), F.lit(" \t\r"))
    full = (
        s.rlike(MARKUP) | (letters(s) < 0.3 * n) | one | s.rlike(r"([^\p{L}\p{N}_\s])\s*\1\s*\1\s*\1") | small
        | (F.length(rest) < 3) | (letters(rest) < 0.4 * F.length(rest)) | (markup > 0.6 * n)
    )
    plain = ~s.contains("://") & ~s.contains("www.") & ~s.contains("@") & s.rlike(PLAIN)
    return F.when(n < 10, True).when(plain, small | one).otherwise(full)


# --- shapes and summaries


def json_root_type(raw: Column) -> Column:
    """object, array, string, number, boolean or null of a JSON text; ``invalid`` for other texts."""
    v = F.try_parse_json(raw)
    first = F.substring(F.ltrim(raw), 1, 1)
    kind = F.when(first == "{", "object").when(first == "[", "array").when(first == '"', "string").when(first.isin("t", "f"), "boolean").when(first == "n", "null").otherwise("number")
    return F.when(v.isNull(), "invalid").otherwise(kind)


def json_schema(raw: Column) -> Column:
    """The schema of a JSON text, null where it is none."""
    return F.schema_of_variant(F.try_parse_json(raw))


def csv_delimiter(head: Column, candidates: str = ",;|\t") -> Column:
    """The delimiter that the first two lines hold equally often, most often first; a comma if there is none."""
    lines = F.split(head, "\n")
    one, two = F.element_at(lines, 1), F.coalesce(F.try_element_at(lines, F.lit(2)), F.element_at(lines, 1))
    count = lambda x, d: F.length(x) - F.length(F.replace(x, F.lit(d), F.lit("")))
    rated = [F.struct(F.when(count(one, d) == count(two, d), count(one, d)).otherwise(0).alias("n"), F.lit(-i).alias("i"), F.lit(d).alias("d")) for i, d in enumerate(candidates)]
    best = F.greatest(*rated)
    return F.when(best["n"] > 0, best["d"]).otherwise(",")


def csv_head(head: Column) -> Column:
    """struct(delimiter, has_header, columns, rows) of the head of a CSV text: up to three sample rows of the fields as they
    stand; the first row is a header if none of its fields is a number or empty."""
    mark = csv_delimiter(head)
    lines = F.filter(F.split(head, "\r?\n"), lambda x: x != "")
    cells = F.transform(F.slice(lines, 1, 4), lambda x: F.transform(F.split(x, F.concat(F.lit("\\Q"), mark, F.lit("\\E"))), lambda c: F.btrim(c, F.lit(' "'))))
    first = F.coalesce(F.try_element_at(cells, F.lit(1)), F.array().cast("array<string>"))
    header = (F.size(first) > 0) & F.forall(first, lambda c: (c != "") & c.try_cast("double").isNull())
    names = F.when(header, first).otherwise(F.transform(first, lambda _, i: F.concat(F.lit("c"), (i + 1).cast("string"))))
    return F.struct(mark.alias("delimiter"), header.alias("has_header"), names.alias("columns"), F.when(header, F.slice(cells, 2, 3)).otherwise(F.slice(cells, 1, 3)).alias("rows"))


def candidate_summary(path: Column, root: str, title: Column, size: Column, keywords: Column) -> Column:
    """One line on a file for a ranking model: relative path, size, title, keywords."""
    relative = F.when(path.startswith(root.rstrip("/") + "/"), F.substring(path, len(root.rstrip("/")) + 2, 1_000_000)).otherwise(path)
    return F.concat_ws(" | ", relative, human_size(size), F.when(F.length(title) > 0, title), F.when(F.size(keywords) > 0, F.array_join(keywords, ", ")))


def quick_tokens(text: Column) -> Column:
    """A quarter of the characters."""
    return F.floor(F.length(text) / 4).cast("int")
