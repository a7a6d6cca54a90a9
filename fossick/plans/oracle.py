"""DuckDB SQL of the catalog's queries, written from what each must give and not from the DataFrame code."""

from __future__ import annotations

from fossick.functions import text
from fossick.sources import views

_WORDS = ("edtion", "ention", "whst")
SQL: dict[str, str] = {}


def _add(name: str, view: str | None, body: str, more: str = "") -> None:
    """``view``: the views that the text uses; ``more``: further table expressions."""
    with_ = ", ".join(x for x in (views.SQL[view] if view else "", more) if x)
    SQL[name] = (f"WITH {with_} " if with_ else "") + body


def _hit(word: str, column: str = "line") -> str:
    return f"contains(lower({column}), '{word}')"


_ANY = "(" + " OR ".join(map(_hit, _WORDS)) + ")"
_IDF = [max(0.5, min(1.0, len(w) / 5)) for w in _WORDS]

_TF = "tf AS (SELECT path, " + ", ".join(f"CAST(sum({_hit(w)}::INT) AS BIGINT) AS t{i}" for i, w in enumerate(_WORDS)) + f" FROM lines WHERE {_ANY} GROUP BY path)"
_RANKED = "ranked AS (SELECT path, t0 + t1 + t2 AS n_lines, round(" + " + ".join(f"CASE WHEN t{i} > 0 THEN {x}::DOUBLE * (1 + ln(t{i})) ELSE 0 END" for i, x in enumerate(_IDF)) + ", 6) AS score FROM tf)"
_add("fast_rank", "lines", "SELECT * FROM ranked", f"{_TF}, {_RANKED}")
_add(
    "fast_rank_pruned", "lines",
    "SELECT path, n_lines, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, max(cut) OVER (ORDER BY rank) AS cuts FROM marked) WHERE rank <= 5 AND (cuts = 0 OR rank = 1)",
    f"{_TF}, {_RANKED}, placed AS (SELECT *, row_number() OVER (ORDER BY score DESC, path) AS rank, max(score) OVER () AS top, lag(score) OVER (ORDER BY score DESC, path) AS before FROM ranked), "
    "marked AS (SELECT *, CASE WHEN score < 0.3 * top OR (before > 0 AND (before - score) / before > 0.5) THEN 1 ELSE 0 END AS cut FROM placed)",
)
_add("grep_or", "lines", " UNION ALL ".join(f"SELECT path, line_number, line, '{w}' AS term FROM lines WHERE {_hit(w)}" for w in _WORDS))
_add("grep_and", "lines", f"SELECT path, line_number, line FROM lines WHERE {_hit('ing')} AND path IN (SELECT path FROM lines WHERE {_hit('tion')}) AND path IN (SELECT path FROM lines WHERE {_hit('able')})")
_add("grep_same_line", "lines", f"SELECT path, line_number, line FROM lines WHERE {_hit('tion')} AND {_hit('whst')}")
_add("grep_not", "lines", f"SELECT path, line_number, line FROM lines WHERE {_hit('whst')} AND path NOT IN (SELECT path FROM lines WHERE {_hit('edtion')} OR {_hit('ention')})")
_add("grep_regex", "lines", "SELECT path, line_number, line, '(?:wh[a-z]t )|(?:[0-9]{4})' AS term FROM lines WHERE regexp_matches(line, '(?i)(?:wh[a-z]t )|(?:[0-9]{4})')")
_add("grep_word", "lines", r"SELECT path, line_number, line FROM lines WHERE regexp_matches(line, '(?i)(?:^|[^\p{L}\p{N}_\p{M}])that(?:$|[^\p{L}\p{N}_\p{M}])')")
_add("grep_invert", "lines", "SELECT path, line_number, line FROM lines WHERE NOT contains(lower(line), 'e')")
_add("grep_count", "lines", f"SELECT path, count(*) AS n_matches FROM lines WHERE {_hit('edtion')} GROUP BY path")
_add("grep_replace", "lines", "SELECT path, line_number, regexp_replace(line, '[0-9]+', '#', 'g') AS line FROM lines WHERE regexp_matches(line, '[0-9]+')")


def _relevance(weights: tuple[float, ...] = (1, 1, 1), saturation: str = "{tf} / ({tf} + 1.0)", factor: str = "1.0::DOUBLE / ((length(line) + 1) / 100.0::DOUBLE + 1)") -> str:
    terms = []
    for w, k in zip(_WORDS, weights, strict=True):
        tf = f"((length(line) - length(replace(lower(line), '{w}', ''))) / {len(w)})::DOUBLE"
        alone = rf"regexp_matches(line, '(?i)(?:^|[^\p{{L}}\p{{N}}]){w}(?:$|[^\p{{L}}\p{{N}}])')"
        idf = max(0.2, min(1.0, len(w) / 5))
        terms.append(f"CASE WHEN {_hit(w)} THEN ({saturation.format(tf=tf)}) * (CASE WHEN {alone} THEN 2 ELSE 1 END) * {k * idf}::DOUBLE ELSE 0 END")
    return f"({' + '.join(terms)}) * {factor}"


_add(
    "line_relevance_topn", "lines", "SELECT path, line_number, line, score, CAST(rank AS INTEGER) AS rank FROM placed WHERE rank <= 3",
    f"scored AS (SELECT path, line_number, line, round({_relevance()}, 6) AS score FROM lines WHERE {_ANY}), placed AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, line_number) AS rank FROM scored)",
)
_add("files_merged", "lines", f"SELECT path, count(*) AS total_matches, round(sum({_relevance()}), 5) AS total_score, CAST(least(5, count(*)) AS INTEGER) AS n_lines FROM lines WHERE {_ANY} GROUP BY path")
_add("line_scores", "lines", f"SELECT path, line_number, round({_relevance((1.0, 2.0, 0.5), '1 + ln({tf})', '1.0::DOUBLE / (ln(length(line) + 2) + 1)')}, 6) AS score FROM lines WHERE {_ANY} AND length(line) > 0")
_add(
    "diverse_lines", "lines", "SELECT path, term, line_number, line, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY turn, pos, line_number) AS place FROM turns) WHERE place <= 5",
    "hits AS (" + " UNION ALL ".join(f"SELECT path, line_number, line, '{w}' AS term, {i} AS pos, round({_relevance()}, 6) AS score FROM lines WHERE {_hit(w)}" for i, w in enumerate(_WORDS)) + "), "
    "once AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY path, line ORDER BY score DESC, line_number, term) = 1), "
    "turns AS (SELECT *, row_number() OVER (PARTITION BY path, term ORDER BY score DESC, line_number) AS turn FROM once)",
)
_add(
    "filename_search", "corpus",
    "SELECT path, filename, CASE kind WHEN 1 THEN 'doc_12' WHEN 2 THEN 'doc_.*7' WHEN 3 THEN 'DOC_9' ELSE '.*_5.*' END AS matched_pattern, "
    "round(CASE WHEN kind = 1 THEN 0.8 WHEN kind = 3 THEN 0.75 WHEN kind = 4 THEN 0.6 WHEN starts_with(filename, 'doc_7') THEN 0.8 ELSE 0.3 + 5.0::DOUBLE / length(filename) * 0.2 END, 6)::DOUBLE AS match_score FROM f WHERE kind IS NOT NULL",
    "f AS (SELECT path, filename, CASE WHEN contains(filename, 'doc_12') THEN 1 WHEN regexp_matches(filename, 'doc_.*7') THEN 2 WHEN contains(filename, 'doc_9') THEN 3 WHEN contains(filename, '_5') THEN 4 END AS kind FROM corpus)",
)
_add("glob_files", "corpus", "SELECT path, size_bytes FROM corpus WHERE filename LIKE 'doc\\_1%.txt' ESCAPE '\\' AND lang <> 'de'")

_HITS = f"hits AS (SELECT DISTINCT path, line_number FROM lines WHERE {_hit('edtion')}), sized AS (SELECT path, line_number, CASE WHEN count(*) OVER (PARTITION BY path) <= 2 THEN 4 ELSE 2 END AS w FROM hits)"
_ISLANDS = (
    f"{_HITS}, spans AS (SELECT DISTINCT path, greatest(1, line_number - w) AS a, line_number + w AS b FROM sized), "
    "flagged AS (SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY path ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS fresh FROM spans), "
    "numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM flagged), "
    "windows AS (SELECT path, min(a) AS first_line, max(b) AS last_line FROM numbered GROUP BY path, island)"
)
_add("context_windows", "lines", "SELECT * FROM windows", _ISLANDS)
_add("evidence_windows", "lines", "SELECT w.path, first_line, last_line, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY line_number) AS content FROM windows w JOIN lines l ON w.path = l.path AND line_number BETWEEN first_line AND last_line GROUP BY ALL", _ISLANDS)
_add(
    "evidence_budget", "corpus", "SELECT source, path, CAST(length(cut) AS INTEGER) AS n_chars, md5(cut) AS md5 FROM (SELECT source, path, left(content, room) AS cut FROM rooms WHERE length(content) <= room OR room > 200)",
    "rooms AS (SELECT source, path, content, CAST(15000 - coalesce(sum(length(content)) OVER (PARTITION BY source ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS room FROM corpus)",
)
_add(
    "candidate_union", "lines", "SELECT path, CAST(row_number() OVER (ORDER BY list, pos, path) AS INTEGER) AS place FROM (SELECT path, list, pos FROM every QUALIFY row_number() OVER (PARTITION BY path ORDER BY list, pos) = 1)",
    "every AS ("
    + " UNION ALL ".join(f"SELECT path, {i} AS list, min(line_number)::BIGINT AS pos FROM lines WHERE {_hit(w)} GROUP BY path" for i, w in enumerate(("edtion", "ention")))
    + " UNION ALL SELECT path, 2, doc_id FROM corpus WHERE size_bytes > 15000)",
)
_FOLDER = "'/corpus/' || source || '/' || lang"
_add(
    "stratified_files", "corpus", "SELECT path, folder, modified_at FROM ranked WHERE r <= share ORDER BY modified_at DESC, path LIMIT 100",
    f"f AS (SELECT path, {_FOLDER} AS folder, doc_id * 7919 % 10007 AS modified_at FROM corpus), ranked AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY modified_at DESC, path) AS r, greatest(1, 100 * count(*) OVER (PARTITION BY folder) // count(*) OVER ()) AS share FROM f)",
)
_add("dir_tree", "corpus", f"SELECT {_FOLDER} AS folder, count(*) AS n_files, CAST(sum(size_bytes) AS BIGINT) AS total_bytes FROM corpus GROUP BY ALL")
_add("common_root", "corpus", "SELECT '/corpus' AS root")
_add("ext_profile", "corpus", "SELECT extension, lang, count(*) AS n, CAST(sum(size_bytes) AS BIGINT) AS total, max(size_bytes) AS largest FROM corpus GROUP BY ALL")
_add(
    "hint_files", "corpus", "SELECT hint, path, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY hint ORDER BY kind, path) AS place FROM hits) WHERE place <= 20",
    "hints AS (SELECT unnest(['doc_7.txt', 'DOC_12', 'doc_99.pdf']) AS hint), hits AS (SELECT hint, path, CASE WHEN filename = hint THEN 1 WHEN contains(lower(filename), lower(hint)) THEN 2 "
    "WHEN lower(split_part(filename, '.', 1)) = lower(split_part(hint, '.', 1)) THEN 3 END AS kind FROM corpus, hints WHERE kind IS NOT NULL)",
)
_add("changed_files", "corpus", "SELECT path, size_bytes AS modified_at FROM corpus WHERE lang = 'fr'")
_add("duplicate_upload_check", "corpus", "SELECT filename AS name, lang = 'en' AS is_duplicate, CASE WHEN lang = 'en' THEN size_bytes END AS known_size FROM corpus")
_add("collection_usage", "corpus", "SELECT source, count(*) AS file_count, CAST(sum(size_bytes) AS BIGINT) AS total_bytes, round(sum(size_bytes) / 1048576.0::DOUBLE, 2) AS mb FROM corpus GROUP BY source")
_add("disk_usage", "corpus", "SELECT CAST(sum(size_bytes) AS BIGINT) AS used_bytes, 10737418240::BIGINT AS max_bytes, round(sum(size_bytes) * 100.0::DOUBLE / 10737418240, 2) AS percent FROM corpus")

# --- text

_MARK = "chr(10) || '[...content sampled...]' || chr(10)"
_BLANKS = "' ' || chr(9) || chr(13)"
_EDGES = "'.,;:!?()[]{}\"'''"
_add(
    "head_mid_tail_sample", "corpus", f"SELECT path, CASE WHEN n <= 2000 THEN content ELSE left(content, 800) || {_MARK} || substring(content, a + 1, b - a) || {_MARK} || right(content, 400) END AS sample FROM s",
    "s AS (SELECT path, content, length(content) AS n, greatest(800, length(content) // 2 - 400) AS a, least(length(content) // 2 + 400, length(content) - 400) AS b FROM corpus)",
)
_add(
    "text_metadata", "corpus",
    f"SELECT path, left(coalesce(list_filter(list_transform(ls, lambda x: trim(regexp_replace(x, '^#+', ''), {_BLANKS})), lambda x: length(x) > 2)[1], ''), 120) AS title, trim(left(content, 800), {_BLANKS} || chr(10)) AS preview, "
    "CASE WHEN strlen(head) > 0 THEN CAST(floor((len(ls) - 1) * (size_bytes / strlen(head)::DOUBLE)) AS BIGINT) ELSE 0 END AS line_count, "
    "array_to_string(list_filter(ws, lambda w, i: list_position(ws, w) = i)[1:10], '|') AS keywords, 'text/plain' AS mime, "
    "CASE WHEN size_bytes < 1024 THEN size_bytes || ' B' WHEN size_bytes < 1048576 THEN format('{:.1f} KB', size_bytes / 1024.0::DOUBLE) ELSE format('{:.1f} MB', size_bytes / 1048576.0::DOUBLE) END AS size FROM w",
    f"l AS (SELECT *, left(content, 1300) AS head, list_transform(string_split(left(content, 1300), chr(10)), lambda x: trim(x, {_BLANKS})) AS ls FROM corpus), "
    f"w AS (SELECT *, list_filter(list_transform(flatten(list_transform(list_filter(ls[1:10], lambda x: length(x) > 5), lambda x: regexp_split_to_array(x, '[ \\t\\r]+'))), lambda x: lower(trim(x, {_EDGES}))), lambda x: length(x) > 3) AS ws FROM l)",
)
_LETTERS = r"length(regexp_replace({0}, '[^\p{{L}}\p{{N}}]', '', 'g'))"
_add(
    "line_noise_filter", "lines", "SELECT path, count(*) AS n, CAST(sum(length(line)) AS BIGINT) AS chars FROM rest WHERE NOT (length(s) < 10 OR marks OR small OR "
    f"{_LETTERS.format('s')} < 0.3 * length(s) OR len(list_filter(cs, lambda c: contains(s, repeat(c, 5)) AND length(s) - length(replace(s, c, '')) > 0.6 * length(s))) > 0 "
    r"OR len(list_filter(cs, lambda c: contains(solid, repeat(c, 4)) AND regexp_matches(c, '[^\p{L}\p{N}_\s]'))) > 0 OR length(left_) < 3 OR "
    f"{_LETTERS.format('left_')} < 0.4 * length(left_) OR " r"length(regexp_replace(s, '[^#*_~`>!\[\](){}|:-]', '', 'g')) > 0.6 * length(s)) GROUP BY path",
    f"stripped AS (SELECT path, line, trim(line, {_BLANKS}) AS s FROM lines), rest AS (SELECT path, line, s, list_distinct(string_split(s, '')) AS cs, regexp_replace(s, '\\s', '', 'g') AS solid, regexp_matches(s, '{text.MARKUP}') AS marks, "
    f"regexp_matches(lower(s), '{text.SMALL_PRINT}') AS small, trim(regexp_replace(regexp_replace(s, '{text.LINKS}', '', 'g'), '{text.MARKUP}', '', 'g'), {_BLANKS}) AS left_ FROM stripped)",
)
_add(
    "chunk_text", "corpus", "SELECT path, CAST(n AS INTEGER) AS n, md5(chunk) AS md5, CAST(length(chunk) AS INTEGER) AS size FROM (SELECT path, n, substring(content, n * 5000 + 1, 5000) AS chunk FROM pieces)",
    "pieces AS (SELECT path, content, unnest(range(0, greatest(1, CAST(ceil(length(content) / 5000.0) AS BIGINT)))) AS n FROM corpus)",
)
_add("probe_windows", "corpus", "SELECT path, count(*) AS n, CAST(sum(least(500, length(content) - s)) AS BIGINT) AS chars, CAST(max(s) AS INTEGER) AS last FROM w GROUP BY path", "w AS (SELECT path, content, unnest(range(0, greatest(1, length(content)), 250)) AS s FROM corpus)")
_add(
    "page_titles", None,
    "SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, CAST(length(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g'))) AS INTEGER) AS text_chars FROM pages",
)
_add("page_links", None, "SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS link FROM pages")
_add(
    "reply_parsing", "messages", "SELECT session_id, turn, CASE WHEN said = '' THEN reply ELSE said END AS summary, said <> '' AND turn % 2 = 0 AS should_save, false AS should_answer FROM r",
    f"r AS (SELECT session_id, turn, trim(content, {_BLANKS} || chr(10)) AS said, '<SUMMARY> ' || content || ' </SUMMARY><SHOULD_SAVE>' || CASE WHEN turn % 2 = 0 THEN 'true' ELSE 'no' END || '</SHOULD_SAVE>' AS reply FROM messages)",
)
_add("json_props", None, "SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS total, max(k) AS most FROM (SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY event_type")
_add("path_parts", "corpus", f"SELECT path, 'doc_' || doc_id AS stem, {_FOLDER} AS parent, 'txt' AS ext, filename AS safe, CAST(instr(filename, '_1') - 1 AS INTEGER) AS from_char, CAST(CASE WHEN contains(filename, '_1') THEN instr(filename, '_1') + 1 ELSE -1 END AS INTEGER) AS to_char FROM corpus")

_add("json_shapes", None, "SELECT CASE event_id % 4 WHEN 0 THEN 'array' WHEN 1 THEN 'invalid' ELSE 'object' END AS kind, count(*) AS n FROM events GROUP BY 1")
_add("csv_delimiters", None, "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN ';' ELSE '|' END AS delimiter FROM nation")
_add("token_estimates", "corpus", "SELECT lang, CAST(sum(length(content) // 4) AS BIGINT) AS quick, CAST(sum(greatest(1, floor(length(content) / 3.5::DOUBLE))) AS BIGINT) AS estimated FROM corpus GROUP BY lang")
_add(
    "scope_paths", "corpus", "SELECT path, min(doc_id) AS pos FROM p WHERE regexp_matches(path, '^/corpus/(src1|src0/en)(/|$)') GROUP BY path",
    f"p AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '-' || path WHEN 1 THEN {_FOLDER} ELSE path END AS path FROM corpus)",
)

# --- scans

_PARTS = "string_split(path, '/')"
_add("scan_walk", "corpus", f"SELECT path, size_bytes FROM corpus WHERE lang <> 'fr' ORDER BY {_PARTS} LIMIT 100")
_add(
    "scan_documents", "corpus", "SELECT path, size_bytes, 'txt' AS extension, true AS is_text FROM (SELECT *, CASE WHEN source = 'src3' AND lang = 'de' THEN 0 WHEN source = 'src0' AND lang = 'en' THEN 1 WHEN source = 'src1' AND lang = 'es' THEN 2 END AS place FROM corpus) "
    "WHERE place IS NOT NULL AND size_bytes BETWEEN 1 AND 5000 ORDER BY place, path LIMIT 7",
)
_SCANNED = f"m AS ({SQL['text_metadata']}), scanned AS (SELECT c.path, 'txt' AS extension, source, lang, size_bytes, CASE WHEN size_bytes > 20000 THEN 'head' ELSE 'full' END AS route, size_bytes <= 5000 AS content_loaded, title, preview, keywords FROM corpus c JOIN m ON c.path = m.path)"
_add("scan_candidates", "corpus", "SELECT path, extension, route, CAST(length(title) AS INTEGER) AS title_chars, CAST(length(preview) AS INTEGER) AS preview_chars, CAST(CASE WHEN route = 'head' OR keywords = '' THEN 0 ELSE len(string_split(keywords, '|')) END AS INTEGER) AS n_keywords, content_loaded FROM scanned", _SCANNED)
_add("scan_summary", "corpus", "SELECT count(*) AS n_files, count(DISTINCT source || '/' || lang) AS n_dirs, count(*) FILTER (content_loaded) AS n_loaded, count(*) FILTER (route <> 'full') AS n_sampled, CAST(sum(size_bytes) AS BIGINT) AS total_bytes FROM scanned", _SCANNED)
_JUDGED = "judged AS (SELECT path, r.* FROM corpus JOIN (VALUES ('doc_15.txt', 'high', 'because 4', 1), ('doc_12.txt', 'medium', 'because 1', 2), ('doc_7.txt', 'low', 'because 0', 3), ('doc_13.txt', 'low', 'because 2', 4)) r(filename, relevance, reason, place) USING (filename))"
_add("scan_ranked", "corpus", "SELECT path, relevance, reason, CAST(place AS INTEGER) AS place FROM judged", _JUDGED)
_add("scan_accepted", "corpus", "SELECT path, relevance FROM judged WHERE relevance <> 'low'", _JUDGED)
_add("folder_listing", "corpus", "SELECT lang AS name, true AS is_dir, CAST(row_number() OVER (ORDER BY lang) AS INTEGER) AS place FROM (SELECT DISTINCT lang FROM corpus WHERE source = 'src0')")
_add("manifest_collections", "corpus", "SELECT source AS collection, count(*) AS file_count, CAST(sum(size_bytes) AS BIGINT) AS total_bytes, TIMESTAMP '2024-01-01' + to_minutes(CAST(max(doc_id % 5000) AS INTEGER)) AS newest FROM corpus GROUP BY source")
_add("candidate_lines", "corpus", "SELECT path, source || '/' || lang || '/' || filename || ' | ' || size || CASE WHEN title = '' THEN '' ELSE ' | ' || title END || ' | ' || source || ', ' || lang AS summary FROM corpus JOIN m USING (path)", f"m AS ({SQL['text_metadata']})")
_add(
    "keyword_shares", "lines",
    "SELECT path, greatest(1, n // 3) AS share, round(1 + ln(n), 6) AS norm, round(ln(n + exp(1.0::DOUBLE)) * CASE WHEN n < 5 THEN exp(-0.5::DOUBLE * (5 - n) / 5) WHEN n > 20 THEN exp(-0.5::DOUBLE * (n - 20) / 20) ELSE 1 END, 6) AS lowered FROM c",
    f"c AS (SELECT path, count(*) AS n FROM lines WHERE {_ANY} GROUP BY path)",
)
_add("iso_times", None, "SELECT event_id, CAST(epoch_us(ts) // 1000000 AS BIGINT) - CASE WHEN event_id % 3 = 1 THEN 7200 ELSE 0 END AS seconds FROM events")

# --- clusters

_add("cluster_get", "clusters", "SELECT id, name, version FROM clusters WHERE id = 'C4e07408562'")
_add(
    "knowledge_activity", "clusters", f"SELECT (SELECT count(*) FROM clusters) AS total, (SELECT round(avg(confidence), 4) FROM clusters) AS mean_confidence, lifecycle, (SELECT count(*) FROM clusters c WHERE c.lifecycle = v.lifecycle) AS n FROM (SELECT unnest({list(views.LIFECYCLES)}) AS lifecycle) v"
)
_add("newest_clusters", "clusters", "SELECT id, name, lifecycle, confidence, create_time AS changed FROM clusters ORDER BY changed DESC, id LIMIT 10")
_add("cluster_references", "clusters", "SELECT id, file, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY j) - 1 AS INTEGER) AS pos FROM evidence WHERE is_found")
_add("cluster_ids", "clusters", "SELECT vec_id, 'C' || sha256(name || chr(10) || chr(10) || content)[1:10] AS content_id, 'FS' || sha256(name)[1:8] AS query_id FROM clusters")
_add(
    "cluster_changes", "clusters",
    "SELECT vec_id, id, CASE WHEN vec_id % 8 = 4 THEN name || '+' ELSE name END AS name, hotness, CAST(version + CASE WHEN vec_id % 8 = 4 THEN 1 ELSE 0 END AS INTEGER) AS version FROM clusters WHERE vec_id % 5 <> 0 "
    "UNION ALL SELECT vec_id, id || 'y', name || '+', NULL, CAST(1 AS INTEGER) FROM clusters WHERE vec_id % 8 = 0",
)
_COS = "list_cosine_similarity(embedding_vector::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id LIMIT 1))"
_add("cluster_similar_topk", "clusters", f"SELECT id, s AS similarity FROM (SELECT id, round({_COS}, 6) AS s FROM clusters WHERE embedding_vector IS NOT NULL ORDER BY s DESC, id LIMIT 10) WHERE s >= 0.2")
_add(
    "cluster_similar_scoped", "clusters", "SELECT id, s AS similarity, avg(inside) AS coverage FROM near JOIN evidence USING (id), LATERAL (SELECT CASE WHEN regexp_matches(file, '^/corpus/src[1-8]/') THEN 1 ELSE 0 END AS inside) WHERE s >= 0.1 GROUP BY id, s HAVING avg(inside) >= 0.5",
    f"near AS (SELECT id, round({_COS}, 6) AS s FROM clusters WHERE embedding_vector IS NOT NULL ORDER BY s DESC, id LIMIT 20)",
)
_add("cluster_stats", "clusters", "SELECT count(*) AS total, count(embedding_vector) AS embedded, " + ", ".join(f"round(coalesce({f}({c}), 0), 4) AS {f}_{c}" for c in ("confidence", "hotness") for f in ("min", "max", "avg")) + " FROM clusters")
for _name, _column, _values in (("lifecycle_distribution", "lifecycle", views.LIFECYCLES), ("abstraction_distribution", "abstraction_level", views.LEVELS)):
    _add(_name, "clusters", f"SELECT value, count({_column}) AS n FROM (SELECT unnest({list(_values)}) AS value) LEFT JOIN clusters ON {_column} = value GROUP BY value")
_add("cluster_timeline", "clusters", "SELECT CAST(create_time AS DATE) AS day, count(*) AS n FROM clusters WHERE create_time BETWEEN TIMESTAMP '2024-01-06' AND TIMESTAMP '2024-02-05' GROUP BY 1")
_add("top_patterns", "clusters", "SELECT pattern, count(*) AS n FROM (SELECT unnest(patterns) AS pattern FROM clusters) GROUP BY pattern ORDER BY n DESC, pattern LIMIT 12")
_add("cluster_graph_edges", "clusters", "SELECT id, target, round(weight, 6) AS weight, source FROM edges")
_add("cluster_find", "clusters", "SELECT id, name, CAST(2 AS INTEGER) AS priority FROM clusters WHERE name LIKE '%Topic 3%' ORDER BY id LIMIT 50")
_add("cluster_listing", "clusters", "SELECT id, hotness, abstraction_level FROM clusters WHERE lifecycle = 'STABLE' ORDER BY hotness DESC NULLS LAST, id LIMIT 40")
_add("cluster_evidence_files", "clusters", "SELECT id, string_agg(doc_id, '|' ORDER BY doc_id) AS doc_ids FROM (SELECT DISTINCT id, doc_id FROM evidence WHERE is_found) GROUP BY id")
_add(
    "cluster_upsert", "clusters",
    "SELECT vec_id, id, name, version FROM clusters WHERE vec_id % 6 <> 0 UNION ALL SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN id ELSE id || 'x' END, name || ' new', CASE WHEN vec_id % 2 = 0 THEN version + 1 ELSE 1 END FROM clusters WHERE vec_id % 3 = 0",
)
_add(
    "cluster_merge", "clusters",
    "SELECT CAST(label AS VARCHAR) AS topic, count(*) AS n_merged, min_by(name, vec_id) || ' (merged)' AS name, 'About topic ' || label AS description, "
    "(SELECT string_agg(p, '|' ORDER BY p) FROM (SELECT DISTINCT unnest(patterns) AS p FROM clusters x WHERE x.label = c.label)) AS patterns, "
    "(SELECT CAST(count(DISTINCT doc_id) AS INTEGER) FROM evidence e JOIN clusters x USING (vec_id) WHERE x.label = c.label) AS n_docs, (SELECT CAST(count(DISTINCT target) AS INTEGER) FROM edges e JOIN clusters x USING (vec_id) WHERE x.label = c.label) AS n_edges, "
    "round(avg(confidence), 6) AS confidence, round(avg(hotness), 6) AS hotness, max(version) + 1 AS version FROM clusters c GROUP BY label",
)
_add(
    "cluster_split", "clusters",
    "SELECT id || '_split' || (part + 1) AS id, name || ' (part ' || (part + 1) || ')' AS name, (SELECT string_agg(doc_id, '|' ORDER BY j) FROM evidence e WHERE e.vec_id = c.vec_id AND (CASE WHEN j < 2 THEN 0 ELSE 1 END) = part) AS doc_ids, "
    "CASE WHEN part = 0 THEN patterns[1] || '|' || patterns[3] ELSE patterns[2] END AS patterns, 'EMERGING' AS lifecycle, CAST(1 AS INTEGER) AS version FROM clusters c, range(0, 2) t(part)",
)
_add(
    "query_fifo", "clusters",
    "SELECT id, array_to_string(CASE WHEN vec_id % 2 = 1 OR list_contains(queries, 'query 3') THEN queries ELSE list_append(queries, 'query 3')[-5:] END, '|') AS queries, "
    "round(CASE WHEN vec_id % 2 = 1 THEN hotness ELSE least(1.0::DOUBLE, CASE WHEN coalesce(hotness, 0) = 0 THEN 0.5 ELSE hotness END + 0.1) END, 6) AS hotness, CAST(version + (vec_id + 1) % 2 AS INTEGER) AS version FROM clusters",
)
SQL["evidence_still_there"] = f"WITH {views.SQL['clusters']}, {views.SQL['corpus']} SELECT id, file FROM evidence WHERE file IN (SELECT path FROM corpus)"

# --- chats

_add(
    "session_search", "messages", "SELECT session_id, CAST(row_number() OVER (ORDER BY list, updated_at DESC, session_id) AS INTEGER) AS place FROM found ORDER BY list, updated_at DESC, session_id LIMIT 30",
    "found AS (SELECT session_id, updated_at, CASE WHEN contains(lower(title), 'tion') THEN 0 ELSE 1 END AS list FROM sessions WHERE contains(lower(title), 'tion') OR session_id IN (SELECT session_id FROM messages WHERE contains(lower(content), 'tion')))",
)
_add(
    "recent_messages", "messages", "SELECT session_id, turn, role, content, CAST(row_number() OVER (PARTITION BY session_id ORDER BY turn, role) AS INTEGER) AS place FROM (SELECT * FROM messages QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY turn DESC, role DESC) <= 3)",
)
_add(
    "session_titles", "messages", "SELECT session_id, CASE WHEN length(f) > 50 THEN left(f, 50) || '...' ELSE f END AS title, CASE WHEN length(l) > 100 THEN left(l, 100) || '...' ELSE l END AS last_message FROM ends",
    "ends AS (SELECT session_id, coalesce(min_by(content, turn) FILTER (role = 'user'), 'New chat') AS f, max_by(content, turn) AS l FROM messages GROUP BY session_id)",
)
_add(
    "history_window", "messages", "SELECT session_id, turn, role, tokens FROM (SELECT *, sum(tokens) OVER (PARTITION BY session_id ORDER BY r) AS used FROM t) WHERE r <= 6 AND (r = 1 OR used <= 200)",
    "t AS (SELECT session_id, turn, role, CAST(greatest(1, floor(length(content) / 3.5::DOUBLE)) AS INTEGER) AS tokens, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC, role DESC) AS r FROM messages)",
)
_add("session_page", "messages", "SELECT session_id, title, message_count FROM sessions ORDER BY updated_at DESC, session_id LIMIT 20 OFFSET 10")
_add("chat_activity", "messages", "SELECT count(*) AS sessions, CAST(sum(message_count) AS BIGINT) AS messages, count(*) FILTER (updated_at >= TIMESTAMP '2024-01-26') AS active FROM sessions")
_add("recent_sessions", "messages", "SELECT session_id, CASE WHEN title = '' THEN 'Untitled' ELSE title END AS title, message_count, CAST(epoch_us(updated_at) // 1000000 AS BIGINT) AS seconds FROM sessions WHERE updated_at >= TIMESTAMP '2024-01-26' ORDER BY updated_at DESC, session_id LIMIT 10")
_add("session_saves", "messages", "SELECT session_id, CASE WHEN session_id % 4 = 1 THEN 'saved ' || title ELSE title END AS title FROM sessions")
_add("history_stats", "messages", "SELECT count(*) AS sessions, CAST(sum(message_count) AS BIGINT) AS messages, count(*) FILTER (updated_at >= TIMESTAMP '2024-01-27') AS last_week, round(count(*) FILTER (updated_at >= TIMESTAMP '2024-01-27') / 7.0::DOUBLE, 2) AS per_day FROM sessions")
_add("message_append", "messages", "SELECT session_id, count(*) + count(*) FILTER (turn = 0) AS message_count, CASE WHEN count(*) FILTER (turn = 0) > 0 THEN greatest(max(ts), TIMESTAMP '2024-02-15') ELSE max(ts) END AS updated_at FROM messages GROUP BY session_id")
_add("session_delete", "messages", "SELECT session_id, count(*) AS n FROM messages WHERE session_id % 3 <> 0 GROUP BY session_id")

_add(
    "context_fragments", "corpus", "SELECT path, CAST(length(c) AS INTEGER) AS n_chars, md5(c) AS md5 FROM (SELECT path, string_agg(chr(10) || '--- Context Fragment ' || i || ' ---' || chr(10) || '...' || substring(content, lo + 1, s + 1250 - lo) || '...' || chr(10), '' ORDER BY s) AS c FROM f GROUP BY path)",
    "f AS (SELECT path, content, s, greatest(0, s - 750) AS lo, row_number() OVER (PARTITION BY path ORDER BY s) AS i FROM corpus, (VALUES (100), (3000), (900)) t(s) WHERE s <= length(content))",
)

# --- usage, events, tables

_add("llm_usage_by_model", "llm_usage", "SELECT model, count(*) AS calls, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS total_tokens FROM llm_usage GROUP BY model")
_add("usage_per_minute", "llm_usage", "SELECT calls, round(m, 3) AS minutes, round(calls / m, 6) AS per_minute FROM (SELECT count(*) AS calls, (epoch_us(max(ts)) - epoch_us(min(ts))) / 60e6::DOUBLE AS m FROM llm_usage)")
_add(
    "rate_limit_window", None,
    "SELECT event_id, a AS in_second, b AS in_minute, a <= 1 AND b <= 2 AS within FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 999999 PRECEDING AND CURRENT ROW) AS a, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS b FROM events)",
)
_add(
    "health_scores", None, "SELECT event_id, score, CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 70 THEN 'good' WHEN score >= 50 THEN 'fair' ELSE 'poor' END AS band FROM s",
    "u AS (SELECT event_id, value % 100 AS c, user_id % 100 AS m, event_id % 100 AS d FROM events), s AS (SELECT event_id, CAST(greatest(0, 100 - CASE WHEN c > 90 THEN 30 WHEN c > 75 THEN 15 ELSE 0 END - CASE WHEN m > 90 THEN 30 WHEN m > 80 THEN 15 ELSE 0 END - CASE WHEN d > 95 THEN 40 WHEN d > 85 THEN 20 ELSE 0 END) AS INTEGER) AS score FROM u)",
)
_add(
    "table_profile", None,
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{'numeric' if num else 'other'}' AS kind, count({c}) AS n, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS \"distinct\", "
        + (f"round(min({c})::DOUBLE, 4) AS min, round(max({c})::DOUBLE, 4) AS max, round(avg({c}), 4) AS mean" if num else "NULL::DOUBLE AS min, NULL::DOUBLE AS max, NULL::DOUBLE AS mean")
        + " FROM lineitem"
        for c, num in [(f"l_{c}", True) for c in ("orderkey", "partkey", "suppkey", "linenumber", "quantity", "extendedprice", "discount", "tax")] + [(f"l_{c}", False) for c in ("returnflag", "linestatus", "shipdate")]
    ),
)
_add("catalog_search", None, f"SELECT table_name, column_name FROM information_schema.columns WHERE table_name IN {views.TABLES} AND (contains(lower(table_name), 'name') OR contains(lower(column_name), 'name'))")
_add("dml_update_delete", None, "SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN n_name || '!' ELSE n_name END AS n_name, n_regionkey FROM nation WHERE n_nationkey % 5 <> 0 UNION ALL SELECT 100, 'NEW', NULL")
_BUCKET = "CAST(epoch_us(ts) // 1000000 // 21600 * 21600 AS BIGINT)"
_add("tumbling_counts", None, f"SELECT {_BUCKET} AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
_add("sliding_counts", None, f"SELECT {_BUCKET} - back AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events, (VALUES (0), (21600)) t(back) GROUP BY ALL")
_add(
    "sessionized_events", None, "SELECT user_id, min(us) AS session_start, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS s FROM f) GROUP BY user_id, s",
    "f AS (SELECT user_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) <= 7200000000 THEN 0 ELSE 1 END AS fresh FROM events)",
)
_add("join_star", None, "SELECT r_name, c_mktsegment, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
_add("semi_anti_customers", None, "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
