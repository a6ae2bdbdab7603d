"""The same results in plain SQL over the given tables, for comparison on another engine.

Each statement works from the tables as they are: it knows nothing of transcripts text or parsing.
"""

from __future__ import annotations

from tertulia.functions.text import ACCENTED_VOWELS, PLAIN_VOWELS
from tertulia.suite import inputs as I


def text_literal(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


NEWLINE = "chr(10)"

TURNS = f"""
turns AS (
  SELECT archivo, turn_no, 'Speaker ' || speaker_num AS speaker, speaker_num,
         (start_sec // 60) || ':' || lpad((start_sec % 60)::VARCHAR, 2, '0') AS timestamp,
         start_sec, text,
         translate(lower(text), '{ACCENTED_VOWELS}', '{PLAIN_VOWELS}') AS folded
  FROM (SELECT 'call_' || conv_id AS archivo, turn::INTEGER AS turn_no,
               CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 3 END AS speaker_num,
               (turn * 7 + length(text) % 23)::INTEGER AS start_sec, text
        FROM conversations))
"""

NEAR = """
near AS (
  SELECT *,
    coalesce(substr(lag(text) OVER calls, 1, 100), '') AS context_before,
    coalesce(substr(lead(text) OVER calls, 1, 100), '') AS context_after
  FROM turns WINDOW calls AS (PARTITION BY archivo ORDER BY turn_no))
"""

RULES = (
    "rules(rule_no, type, category, intensity, type_ord, category_ord, pattern) AS (VALUES\n  "
    + ",\n  ".join(
        f"({r.rule_no}, {text_literal(r.type)}, {text_literal(r.category)}, {r.intensity}, "
        f"{r.type_ord}, {r.category_ord}, {text_literal(r.pattern)})"
        for r in I.RULES.rules()
    )
    + ")"
)


def hits(source: str, client: str = "1") -> str:
    return f"""
hits AS (
  SELECT * FROM (
    SELECT t.*, r.*, regexp_extract(t.folded, r.pattern) AS matched_text,
           row_number() OVER (PARTITION BY t.archivo, t.turn_no, r.type_ord, r.category_ord
                              ORDER BY r.rule_no) AS place
    FROM {source} t JOIN rules r ON regexp_matches(t.folded, r.pattern)
    WHERE t.speaker_num = {client})
  WHERE place = 1)
"""


def clean(value: str, fillers: tuple[str, ...] = I.CLEANING.fillers) -> str:
    plain = f"strip_accents(lower({value}))"
    unfilled = f"regexp_replace({plain}, '({'|'.join(fillers)})', ' ', 'gi')"
    unpunctuated = rf"regexp_replace({unfilled}, '[^\p{{L}}\p{{N}}_\s]', ' ', 'g')"
    return rf"trim(regexp_replace({unpunctuated}, '\s+', ' ', 'g'))"


def phrase(value: str) -> str:
    out = rf"regexp_replace({value}, '\\b', '', 'g')"
    out = rf"regexp_replace({out}, '\(\?:.*?\)', '', 'g')"
    out = rf"regexp_replace({out}, '\(.*?\?\)', '', 'g')"
    out = rf"regexp_replace({out}, '[\\()?|]', ' ', 'g')"
    return rf"trim(regexp_replace({out}, '\s+', ' ', 'g'))"


def chunked(value: str, ends: str = r"[\n.!?]+") -> str:
    """List of relevant chunks of a text."""
    o = I.CHUNKING
    sentences = (
        f"list_filter(list_transform(string_split_regex({value}, '{ends}'), lambda s: trim(s)), "
        f"lambda s: length(s) > {o.min_sentence_length})"
    )
    windows = (
        f"list_transform(range(0, len({sentences}), {o.window - o.overlap}), "
        f"lambda i: array_to_string(({sentences})[i + 1 : i + {o.window}], ' '))"
    )
    words = r"len(list_filter(string_split_regex(c, '\s+'), lambda w: w <> ''))"
    listed = ", ".join(text_literal(p) for p in o.irrelevant)
    return (
        f"list_filter({windows}, lambda c: {words} >= {o.min_words} "
        f"AND lower(trim(c)) NOT IN ({listed}))"
    )


def trimmed_lines(value: str) -> str:
    return (
        f"list_filter(list_transform(string_split({value}, {NEWLINE}), lambda l: trim(l)), lambda l: l <> '')"
    )


def metrics(label_source: str = "text") -> str:
    score = (
        f"CASE length({label_source}) % 4 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END"
    )
    return f"""
timed AS (
  SELECT *, greatest(0, coalesce(lead(start_sec) OVER (PARTITION BY archivo ORDER BY turn_no) - start_sec, 0))
            AS duration_sec, {score} AS score
  FROM turns),
metrics AS (
  SELECT archivo, max(start_sec)::INTEGER AS duracion_total_seg,
    coalesce(sum(duration_sec) FILTER (speaker_num = 1), 0)::INTEGER AS tiempo_speaker1_seg,
    coalesce(sum(duration_sec) FILTER (speaker_num = 2), 0)::INTEGER AS tiempo_speaker2_seg,
    coalesce(round(avg(score) FILTER (speaker_num = 1), 3), 0.0) AS sentimiento_speaker1,
    coalesce(round(avg(score) FILTER (speaker_num = 2), 3), 0.0) AS sentimiento_speaker2
  FROM timed GROUP BY archivo)
"""


FINAL = f"""
WITH {TURNS}, {RULES}, {hits('turns')}, {metrics()},
found AS (
  SELECT ' ' || archivo AS archivo_origen, archivo AS call, turn_no, rule_no, text AS frase_original,
         type || ', ' || category || ',,' AS categoria,
         CASE WHEN intensity >= 2 THEN 'si' WHEN intensity = 1 THEN 'no' END AS exito
  FROM hits),
told AS (SELECT 'call_' || doc_id AS call, text AS resumen FROM documents WHERE lang <> 'de' AND text <> ''),
final AS (
  SELECT m.*, f.archivo_origen, f.turn_no, f.rule_no, f.frase_original, f.categoria, f.exito, s.resumen
  FROM metrics m
  LEFT JOIN found f ON m.archivo IS NOT DISTINCT FROM f.call
  LEFT JOIN told s ON m.archivo IS NOT DISTINCT FROM s.call)
"""

KPIS = """
  round((avg(sentimiento_speaker1) + avg(sentimiento_speaker2)) / 2, 3) AS sentimiento_prom,
  round(avg(duracion_total_seg) / 60, 2) AS duracion_prom_min
"""

SCORED = """
WITH parts AS (
  SELECT vec_id, label, unnest(embedding)::DOUBLE AS value, generate_subscripts(embedding, 1) AS place
  FROM embeddings),
means AS (SELECT label, place, avg(value) AS value FROM parts GROUP BY ALL),
centroids AS (SELECT label AS cat_id, list(value ORDER BY place) AS centre FROM means GROUP BY label),
pairs AS (
  SELECT e.vec_id, e.label, c.cat_id,
         list_cosine_similarity(e.embedding::DOUBLE[], c.centre) AS similarity
  FROM embeddings e CROSS JOIN centroids c),
scored AS (
  SELECT *, 'label ' || cat_id AS frase FROM (
    SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(similarity, 12) DESC, cat_id) AS place
    FROM pairs)
  WHERE place = 1)
"""


def letters(value: str) -> str:
    counts = (f"length({value}) - length(replace({value}, '{c}', ''))" for c in I.LETTERS)
    return "[" + ", ".join(counts) + "]::DOUBLE[]"


DETECTED = f"""
WITH {TURNS}, {RULES},
said AS (
  SELECT archivo, turn_no,
    array_to_string(list_filter(list_transform(string_split(text, {NEWLINE}), lambda l: {clean('l')}),
                                lambda l: l <> ''), ' ') AS texto
  FROM turns),
cut AS (SELECT archivo, turn_no, {chunked('texto')} AS chunks FROM said),
pieces AS (
  SELECT archivo, turn_no, unnest(range(len(chunks)))::INTEGER AS chunk_no, unnest(chunks) AS chunk FROM cut),
phrases AS (
  SELECT row_number() OVER (ORDER BY rule_no) - 1 AS cat_id, frase, type AS categoria, category AS tipo,
         {letters('frase')} AS vector
  FROM (SELECT *, {phrase('pattern')} AS frase FROM rules) WHERE frase <> ''),
coded AS (SELECT *, {letters('chunk')} AS vector FROM pieces),
pairs AS (
  SELECT c.archivo, c.turn_no, c.chunk_no, c.chunk, p.cat_id, p.frase, p.categoria, p.tipo,
    CASE WHEN list_sum(c.vector) = 0 OR list_sum(p.vector) = 0 THEN 0.0
         ELSE list_cosine_similarity(c.vector, p.vector) END AS similarity
  FROM coded c CROSS JOIN phrases p),
detected AS (
  SELECT archivo AS archivo_origen, chunk AS frase_original, frase AS patron_mas_cercano, categoria, tipo,
         round(similarity, 3) AS similitud, turn_no, chunk_no
  FROM (SELECT *, row_number() OVER (PARTITION BY archivo, turn_no, chunk_no
                                     ORDER BY round(similarity, 12) DESC, cat_id) AS place FROM pairs)
  WHERE place = 1 AND similarity >= {I.LETTER_THRESHOLD})
"""

PROMPT = (
    "'Frase: ' || frase_original || chr(10) || 'Categoria ' || categoria || ' / tipo ' || tipo "
    "|| '. {Responde SI o NO}'"
)

REPORTS = f"""
WITH {TURNS}, {RULES}, {hits('turns')},
per_type AS (
  SELECT archivo, type, count(*) AS n, min(turn_no * 1000 + rule_no) AS first FROM hits GROUP BY ALL),
typed AS (
  SELECT archivo, string_agg(type || ':' || n, ',' ORDER BY type) AS objection_types,
         string_agg(type, '>' ORDER BY first) AS type_order
  FROM per_type GROUP BY archivo),
counted AS (SELECT archivo, count(*) AS n, avg(intensity) AS level FROM hits GROUP BY archivo),
reports AS (
  SELECT t.archivo AS file, count(*) AS total_turns, count(*) FILTER (speaker_num = 1) AS client_turns,
         coalesce(any_value(c.n), 0)::BIGINT AS objections_found,
         coalesce(any_value(y.objection_types), '') AS objection_types,
         coalesce(any_value(y.type_order), '') AS type_order,
         coalesce(any_value(c.level), 0.0) AS avg_intensity
  FROM turns t LEFT JOIN counted c USING (archivo) LEFT JOIN typed y USING (archivo)
  GROUP BY t.archivo)
"""

REVIEWED = f"""
WITH answers AS (
  SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'SÍ, ES OBJECIÓN'
                      WHEN quality = 1 AND toxic = 1 THEN 'POSIBLE'
                      WHEN quality = 0 AND toxic = 0 THEN 'NO' END AS respuesta_llm
  FROM labels),
reviewed AS (
  SELECT d.doc_id, 'call_' || d.doc_id AS archivo_origen, d.text AS frase_original, d.source AS categoria,
         d.lang AS tipo, a.respuesta_llm,
         {' OR '.join(f"contains(a.respuesta_llm, '{k}')" for k in I.KEYWORDS)} AS validado_llm
  FROM documents d LEFT JOIN answers a USING (doc_id))
"""

CLEANED = f"""
WITH {TURNS},
blocks AS (
  SELECT archivo, turn_no,
    speaker || ':  {{ ' || timestamp || ' }}' || {NEWLINE} || array_to_string(
      list_transform(string_split(text, {NEWLINE}), lambda l: CASE WHEN trim(l) = '' THEN l ELSE {clean('l')} END),
      {NEWLINE}) AS block
  FROM turns),
cleaned AS (
  SELECT archivo, '0 00' || {NEWLINE} || 'before the first speaker' || {NEWLINE} || {NEWLINE}
    || string_agg(block, {NEWLINE} || {NEWLINE} ORDER BY turn_no) AS clean
  FROM blocks GROUP BY archivo)
"""

DETECTIONS = f"""
{SCORED}
SELECT 'call_' || label AS archivo_origen, 'chunk ' || vec_id AS frase_original, frase AS patron_mas_cercano,
       CASE WHEN cat_id % 2 = 0 THEN 'EVEN' ELSE 'ODD' END AS categoria, 't' || cat_id AS tipo,
       round(similarity, 3) AS similitud, vec_id AS turn_no
FROM scored WHERE similarity >= {I.THRESHOLD}
"""

DOCUMENTS = f"""
WITH {TURNS}, {RULES}, {NEAR}, {hits('near')},
details AS (
  SELECT archivo, count(*) AS n,
    string_agg(concat_ws('|', type, matched_text, timestamp, context_before, context_after), {NEWLINE}
               ORDER BY turn_no, rule_no) AS objections
  FROM hits GROUP BY ALL),
said AS (
  SELECT archivo, string_agg(concat_ws('|', speaker, timestamp, text), {NEWLINE} ORDER BY turn_no) AS turns
  FROM turns GROUP BY ALL)
SELECT s.archivo AS file, 0 AS part, coalesce(d.n, 0)::INTEGER AS objections_found,
       coalesce(d.objections, '') AS objections, s.turns
FROM said s LEFT JOIN details d ON s.archivo = d.archivo
"""

TRIMMED = TURNS.replace(
    "(turn * 7 + length(text) % 23)::INTEGER AS start_sec, text",
    "(turn * 7 + length(text) % 23)::INTEGER AS start_sec, trim(text, ' ' || chr(9) || chr(10)) AS text",
)

# Silent turns: the metrics parse takes the next header as the speech of a silent turn, so of a run of headers
# every second one is lost; with one turn or none there is no row.
SPARSE = f"""
WITH {TURNS},
sparse AS (
  SELECT *, count(*) OVER (PARTITION BY archivo) AS n, length(text) <= {I.SILENT} AS silent FROM turns),
placed AS (
  SELECT *, turn_no - coalesce(max(CASE WHEN NOT silent THEN turn_no END)
      OVER (PARTITION BY archivo ORDER BY turn_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) - 1 AS run
  FROM sparse WHERE n > 1),
headed AS (
  SELECT archivo, turn_no, speaker, speaker_num, start_sec,
    CASE WHEN silent THEN coalesce(lead(speaker || ':  {{ ' || timestamp || ' }}') OVER calls, '')
         ELSE split_part(ltrim(text, ' ' || chr(9) || chr(10)), {NEWLINE}, 1) END AS text
  FROM placed WINDOW calls AS (PARTITION BY archivo ORDER BY turn_no)
  QUALIFY run % 2 = 0)
"""

SCAN = f"""
SELECT CASE WHEN broken THEN 'not valid UTF-8' END AS parse_error, count(*) AS files,
       sum(CASE WHEN broken THEN 0 ELSE chars END)::BIGINT AS chars
FROM (SELECT sum(length(text) + 1) AS chars,
             bool_or(source = '{I.OTHER_ENCODING}' AND regexp_matches(text, '[\u0080-\u00FF]')) AS broken
      FROM documents GROUP BY source, lang, doc_id // {I.FILE_DOCS})
GROUP BY ALL"""

METRICS_QUERY = f"WITH {TURNS}, {metrics()} SELECT * FROM metrics"

ORACLES = {
    "q01_turn_parse_full": f"""
WITH {TURNS}
SELECT archivo, turn_no, speaker, speaker_num, timestamp, start_sec,
       trim(text, ' ' || chr(9) || chr(10)) AS text
FROM turns""",
    "q02_turn_parse_clean": f"""
WITH {TURNS}
SELECT archivo, turn_no, speaker_num, array_to_string({trimmed_lines('text')}, ' ') AS texto FROM turns""",
    "q03_turn_parse_metrics": f"""
WITH {TURNS}
SELECT archivo, turn_no, speaker, start_sec,
       split_part(ltrim(text, ' ' || chr(9) || chr(10)), {NEWLINE}, 1) AS speech
FROM turns""",
    "q04_clean_call": f"{CLEANED} SELECT * FROM cleaned",
    "q05_clean_text": f"SELECT doc_id, {clean('text')} AS clean FROM documents",
    "q06_fold_vowels": f"""
SELECT doc_id, translate(lower(text), '{ACCENTED_VOWELS}', '{PLAIN_VOWELS}') AS folded FROM documents""",
    "q07_catalog": rf"""
SELECT (row_number() OVER (ORDER BY doc_id) - 1)::INTEGER AS cat_id, frase, source AS categoria, lang AS tipo
FROM (SELECT doc_id, source, lang,
        {phrase(r"'\b(?:' || lang || ') ' || text || ' (' || source || ')?\b'")} AS frase FROM documents)
WHERE frase <> ''""",
    "q08_context": f"""
WITH {TURNS}, {NEAR}
SELECT archivo, turn_no, context_before, context_after FROM near WHERE speaker_num = 1""",
    "q09_rule_objections": f"""
WITH {TURNS}, {RULES}, {NEAR},
listened AS (
  SELECT *, CASE WHEN bool_or(speaker_num = 3) OVER (PARTITION BY archivo) THEN 2 ELSE 1 END AS client FROM near),
{hits('listened', 't.client')}
SELECT archivo, turn_no, rule_no, type, category, intensity, matched_text, pattern, timestamp, speaker,
       text AS full_text, context_before, context_after
FROM hits""",
    "q10_talk_time_sentiment": METRICS_QUERY,
    "q11_chunks": f"""
WITH {TURNS}, cut AS (SELECT archivo, turn_no, {chunked('text')} AS chunks FROM turns)
SELECT archivo, turn_no, unnest(range(len(chunks)))::INTEGER AS chunk_no, unnest(chunks) AS chunk FROM cut""",
    "q12_semantic_top1": f"""
{SCORED} SELECT vec_id, cat_id, frase, round(similarity, 6) AS similarity FROM scored""",
    "q13_detections": f"{DETECTIONS} ORDER BY archivo_origen, turn_no",
    "q14_prompts": f"""
SELECT doc_id, {PROMPT} AS prompt,
       {text_literal(I.INSTRUCTION)} || {NEWLINE} || {NEWLINE} || frase_original AS summary_prompt
FROM (SELECT doc_id, text AS frase_original, source AS categoria, lang AS tipo FROM documents)""",
    "q15_validated": f"""
{REVIEWED}
SELECT archivo_origen, categoria, respuesta_llm, doc_id, frase_original, tipo, validado_llm
FROM reviewed WHERE validado_llm""",
    "q16_final_calls": f"{FINAL} SELECT * FROM final",
    "q17_call_kpis": f"""
{FINAL}
SELECT 'Varias' AS id_llamada, 'Varias' AS exito, {KPIS}, 'Múltiples llamadas' AS resumen FROM final
UNION ALL
SELECT archivo, CASE WHEN avg(CASE WHEN exito = 'si' THEN 1 ELSE 0 END) > 0.5 THEN 'Sí' ELSE 'No' END, {KPIS},
       first(resumen ORDER BY turn_no NULLS FIRST, rule_no NULLS FIRST)
FROM final GROUP BY archivo""",
    "q17b_per_call_means": f"""
{FINAL} SELECT {KPIS} FROM (SELECT * FROM metrics)""",
    "q18_category_distribution": f"""
{FINAL}
SELECT trim(name) AS categoria, count(*) AS cantidad
FROM (SELECT unnest(string_split(categoria, ',')) AS name FROM final WHERE categoria IS NOT NULL)
WHERE trim(name) <> '' GROUP BY ALL""",
    "q19_call_report": f"""
{REPORTS}
SELECT file, total_turns, client_turns, objections_found, objection_types, type_order,
       round(avg_intensity, 6) AS avg_intensity FROM reports""",
    "q19b_counts_from_objections": f"""
{REPORTS}
SELECT file AS archivo, total_turns, client_turns, objections_found, objection_types,
       round(avg_intensity, 6) AS avg_intensity FROM reports""",
    "q20_corpus_stats": f"""
{REPORTS},
ranked AS (
  SELECT type, count(*) AS files, min((archivo, first)) AS seen FROM per_type GROUP BY type)
SELECT count(*) AS total_files, sum(objections_found)::BIGINT AS total_objections,
       round(sum(objections_found) / count(*), 6) AS avg_objections_per_file,
       (SELECT type FROM ranked ORDER BY files DESC, seen LIMIT 1) AS most_common_objection,
       round(avg(avg_intensity), 6) AS overall_avg_intensity
FROM reports""",
    "q21_run_counts": f"""
{SCORED}
SELECT 'call_' || label AS archivo, count(*) AS chunks,
       count(*) FILTER (similarity >= {I.THRESHOLD}) AS detected,
       count(*) FILTER (similarity < {I.THRESHOLD}) AS discarded
FROM scored GROUP BY label""",
    "q21b_review_counts": f"""
{REVIEWED} SELECT count(*) AS total, count(*) FILTER (validado_llm) AS validated FROM reviewed""",
    "q22_call_list": f"""
{FINAL} SELECT 'Todas' AS archivo UNION ALL SELECT DISTINCT archivo FROM final""",
    "q23_phrase_detail": f"{FINAL} SELECT frase_original, categoria FROM final",
    "q24_report_documents": DOCUMENTS,
    "q25_preview": f"""
{FINAL}
SELECT archivo, turn_no, rule_no, duracion_total_seg, categoria
FROM final ORDER BY archivo, turn_no NULLS FIRST, rule_no NULLS FIRST LIMIT 5""",
    "q26_semantic_detection": f"{DETECTED} SELECT * FROM detected",
    "q27_reviewed_detection": f"""
{DETECTED},
answered AS (
  SELECT *, CASE length({PROMPT}) % 5 WHEN 0 THEN 'SI, ES UNA OBJECIÓN' WHEN 1 THEN 'NO' WHEN 2 THEN 'SÍ.' END
            AS respuesta_llm
  FROM detected)
SELECT archivo_origen, similitud, frase_original, patron_mas_cercano, categoria, tipo, turn_no, chunk_no,
       respuesta_llm, true AS validado_llm
FROM answered WHERE respuesta_llm LIKE 'S%'""",
    "q28_scored_sentiment": METRICS_QUERY,
    "q29_summaries": f"""
SELECT archivo, n || ' caracteres' AS resumen
FROM (SELECT 'call_' || doc_id AS archivo, length(text) + {len(I.INSTRUCTION) + 2} AS n FROM documents)
WHERE n % 7 BETWEEN 1 AND 5""",
    "q30_renumbered_turns": f"""
WITH {TURNS}
SELECT archivo, turn_no AS place, text,
       (row_number() OVER (PARTITION BY archivo ORDER BY turn_no) - 1)::INTEGER AS turn_no
FROM turns WHERE speaker_num = 1""",
    "q31_dashboard_columns": METRICS_QUERY,
    "q32_clean_sink": f"{CLEANED} SELECT archivo, clean FROM cleaned",
    "q33_delimited_round_trip": f"{FINAL} SELECT * FROM final",
    "q34_detection_files": f"SELECT * EXCLUDE (turn_no) FROM ({DETECTIONS})",
    "q35_report_sink": DOCUMENTS,
    "q36_objection_job": f"""
WITH {TRIMMED}, {RULES}, {NEAR}, {hits('near')}
SELECT archivo, turn_no, rule_no, type, category, intensity, matched_text, pattern, timestamp, speaker,
       text AS full_text, context_before, context_after
FROM hits""",
    "q37_report_job": f"""
WITH {TRIMMED}, {RULES}, {NEAR},
listened AS (
  SELECT *, CASE WHEN bool_or(speaker_num = 3) OVER (PARTITION BY archivo) THEN 2 ELSE 1 END AS client FROM near),
{hits('listened', 't.client')},
typed AS (
  SELECT archivo, string_agg(type || ':' || n, ',' ORDER BY type) AS objection_types
  FROM (SELECT archivo, type, count(*) AS n FROM hits GROUP BY ALL) GROUP BY archivo),
found AS (
  SELECT archivo, count(*) AS n, avg(intensity) AS level,
    string_agg(concat_ws('|', type, matched_text, timestamp, context_before, context_after), {NEWLINE}
               ORDER BY turn_no, rule_no) AS objections
  FROM hits GROUP BY archivo)
SELECT t.archivo AS file, count(*)::INTEGER AS total_turns, (count(*) FILTER (speaker_num = client))::INTEGER AS client_turns,
       coalesce(any_value(f.n), 0)::INTEGER AS objections_found,
       coalesce(any_value(y.objection_types), '') AS objection_types,
       round(coalesce(any_value(f.level), 0.0), 6) AS avg_intensity,
       coalesce(any_value(f.objections), '') AS objections
FROM listened t LEFT JOIN found f USING (archivo) LEFT JOIN typed y USING (archivo)
GROUP BY t.archivo""",
    "q38_corpus_job": f"""
WITH {TRIMMED.replace('FROM conversations', f"FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS all_turns FROM conversations) WHERE all_turns > 1 AND length(text) > {I.SILENT}")},
{RULES}, {hits('turns')}
SELECT (SELECT count(DISTINCT conv_id) FROM conversations) AS total_files, count(*) AS total_objections,
       round(count(*) / (SELECT count(DISTINCT conv_id) FROM conversations), 6) AS mean
FROM hits""",
    "q39_metrics_job": SPARSE + ", " + metrics().replace("FROM turns)", "FROM headed)", 1) + """
SELECT *, NULL::VARCHAR AS parse_error FROM metrics""",
    "q40_folder_scan": SCAN,
    "q41_folder_stream": SCAN,
    "q42_one_call": f"""
{FINAL},
one AS (SELECT * FROM final WHERE archivo = (SELECT min(archivo) FROM final)),
kpis AS (
  SELECT any_value(archivo) AS id, CASE WHEN avg(CASE WHEN exito = 'si' THEN 1 ELSE 0 END) > 0.5 THEN 'Sí' ELSE 'No' END
         AS exito, {KPIS}, count(frase_original) AS phrases
  FROM one)
SELECT unnest(['id', 'exito', 'sentimiento', 'minutos', 'flag', 'flag of all', 'sentiment', 'minutes',
               'summary of all', 'phrases']) AS figure,
       unnest([id, exito, sentimiento_prom::VARCHAR, duracion_prom_min::VARCHAR, exito, 'Varias',
               sentimiento_prom::VARCHAR, duracion_prom_min::VARCHAR, 'Múltiples llamadas', phrases::VARCHAR]) AS value
FROM kpis""",
    "q43_detection_array": f"SELECT * EXCLUDE (turn_no) FROM ({DETECTIONS})",
    "q44_united_detections": f"""
WITH found AS ({DETECTIONS})
SELECT *, 0 AS chunk_no FROM found UNION ALL SELECT *, NULL FROM found""",
    "q45_comma_chunks": f"""
WITH {TURNS}, cut AS (SELECT archivo, turn_no, {chunked('text', '[,;]')} AS chunks FROM turns)
SELECT archivo, turn_no, unnest(range(len(chunks)))::INTEGER AS chunk_no, unnest(chunks) AS chunk FROM cut""",
    "q46_failed_encodings": f"""
{DETECTED}
SELECT archivo, count(*) AS chunks, count(*) FILTER (length(chunk) % 11 = 0) AS failed FROM pieces GROUP BY archivo""",
    "q47_sliced_catalog": f"""
{SCORED} SELECT vec_id, cat_id, frase, round(similarity, 6) AS similarity FROM scored""",
    "q49_split_arrays": f"SELECT * EXCLUDE (turn_no) FROM ({DETECTIONS})",
    "q50_split_table": f"{FINAL} SELECT * FROM final",
    "q51_resumed_answers": f"""
SELECT doc_id, n % 5 = 3 AS failed, CASE WHEN first AND n % 5 <> 3 THEN 1 ELSE 2 END AS job,
       CASE n % 5 WHEN 0 THEN 'si, es una objeción' WHEN 1 THEN 'no' WHEN 2 THEN 'Sí.' END AS answer
FROM (SELECT doc_id, length(text) + {len(I.INSTRUCTION) + 2} AS n,
             bool_or(lang = '{I.FIRST_LANG}') OVER (PARTITION BY text) AS first
      FROM documents)""",
    "q52_published_clean": f"{CLEANED} SELECT archivo, clean FROM cleaned",
    "q53_pruned_catalog": """
WITH pairs AS (
  SELECT a.vec_id, e.vec_id::INTEGER AS cat_id, 't' || e.label AS tipo,
         list_cosine_similarity(a.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS similarity
  FROM embeddings a JOIN embeddings e ON a.label % 2 = 1 AND e.label % 2 = 0)
SELECT vec_id, cat_id, tipo, round(similarity, 6) AS similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(similarity, 12) DESC, cat_id) AS place FROM pairs)
WHERE place = 1""",
    "q54_long_transcripts": f"""
WITH {TURNS},
placed AS (SELECT *, substr(archivo, 6)::BIGINT AS call, substr(archivo, 6)::BIGINT // {I.FILE_DOCS} AS part FROM turns)
SELECT part, speaker, speaker_num, timestamp, start_sec, trim(text, ' ' || chr(9) || chr(10)) AS text,
       (row_number() OVER (PARTITION BY part ORDER BY call, turn_no) - 1)::INTEGER AS turn_no
FROM placed""",
    "q48_growing_totals": f"""
{DETECTED.replace(TURNS, TRIMMED)},
{hits('turns')},
per_type AS (SELECT archivo, type, min(turn_no * 1000 + rule_no) AS first FROM hits GROUP BY ALL),
ranked AS (SELECT type, count(*) AS files, min((archivo, first)) AS seen FROM per_type GROUP BY type),
levels AS (
  SELECT archivo, coalesce(avg(intensity), 0.0) AS level, count(intensity) AS n
  FROM (SELECT DISTINCT archivo FROM turns) LEFT JOIN hits USING (archivo) GROUP BY archivo),
corpus AS (
  SELECT count(*) AS total_files, sum(n)::BIGINT AS total_objections, round(sum(n) / count(*), 6) AS per_file,
         (SELECT type FROM ranked ORDER BY files DESC, seen LIMIT 1) AS common, round(avg(level), 6) AS level
  FROM levels)
SELECT 'corpus' AS total,
       unnest(['total_files', 'total_objections', 'avg_objections_per_file', 'most_common_objection',
               'overall_avg_intensity']) AS figure,
       unnest([total_files::VARCHAR, total_objections::VARCHAR, per_file::VARCHAR, common, level::VARCHAR]) AS value
FROM corpus
UNION ALL
SELECT 'runs', unnest(['chunks', 'detected', 'failed', 'discarded']),
       unnest([n::VARCHAR, found::VARCHAR, '0', (n - found)::VARCHAR])
FROM (SELECT (SELECT count(*) FROM pieces) AS n, (SELECT count(*) FROM detected) AS found)
UNION ALL
SELECT 'categories', name, count(*)::VARCHAR
FROM (SELECT unnest([type, category]) AS name FROM hits) GROUP BY name""",
}
