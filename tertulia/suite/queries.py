"""One query per operator or job, each over the whole given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tertulia import schemas
from tertulia.config import ReportOptions
from tertulia.functions import prompts, text
from tertulia.operators import calls, catalogs, dashboard, parsing, reports, rules, scoring, semantic, turns
from tertulia.plans import calls as call_jobs
from tertulia.plans import detection, objections
from tertulia.sources import splitting, tables
from tertulia.sources.answers import AnswerStore
from tertulia.sources.folder_source import write_files
from tertulia.sources.long_transcripts import read_long_turns
from tertulia.sources.published import publish, read_published
from tertulia.sources.staging import fresh_folder, settle
from tertulia.sources.transcripts import read_transcripts, with_rejects, write_clean, write_reports
from tertulia.streaming import folders, totals
from tertulia.suite import inputs as I

#: Vector numbers whose detections one JSON array holds at most, and bytes of the ranges that files are cut into.
ARRAY_BLOCK, CUT = 1000, 1 << 14


def turn_parse_full(spark: SparkSession, folder: str) -> DataFrame:
    parsed = parsing.parse_turns(I.conversation_transcripts(spark, folder))
    return parsed.select(
        "archivo", "turn_no", "speaker", "speaker_num", "timestamp", "start_sec", "text"
    )


def turn_parse_clean(spark: SparkSession, folder: str) -> DataFrame:
    texts = I.conversation_transcripts(spark, folder).withColumnRenamed("raw", "clean")
    return parsing.parse_clean_turns(texts).select("archivo", "turn_no", "speaker_num", "texto")


def turn_parse_metrics(spark: SparkSession, folder: str) -> DataFrame:
    parsed = parsing.parse_metric_turns(I.conversation_transcripts(spark, folder))
    return parsed.select("archivo", "turn_no", "speaker", "start_sec", "speech")


def clean_call(spark: SparkSession, folder: str) -> DataFrame:
    return parsing.clean_call(I.conversation_transcripts(spark, folder), I.CLEANING)


def clean_text(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = text.clean_text(F.col("text"), I.CLEANING.fillers)
    return I.table(spark, folder, "documents").select("doc_id", cleaned.alias("clean"))


def fold_vowels(spark: SparkSession, folder: str) -> DataFrame:
    folded = text.fold_vowels(F.col("text"))
    return I.table(spark, folder, "documents").select("doc_id", folded.alias("folded"))


def catalog(spark: SparkSession, folder: str) -> DataFrame:
    return semantic.catalog_phrases(I.document_rules(spark, folder))


def context(spark: SparkSession, folder: str) -> DataFrame:
    near = turns.with_context(I.conversation_turns(spark, folder), 100)
    return turns.client_turns(near, 1).select("archivo", "turn_no", "context_before", "context_after")


def rule_objections(spark: SparkSession, folder: str) -> DataFrame:
    all_turns = I.conversation_turns(spark, folder)
    return rules.detect_objections(all_turns, I.RULES, 1, I.special_clients(all_turns))


def talk_time_sentiment(spark: SparkSession, folder: str) -> DataFrame:
    return _metrics(I.conversation_turns(spark, folder))


def _metrics(all_turns: DataFrame) -> DataFrame:
    timed = turns.with_duration(all_turns.select("archivo", "turn_no", "speaker", "start_sec", "text"))
    return calls.call_metrics(timed.withColumn("label", I.text_label(F.col("text"))))


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    spoken = I.conversation_turns(spark, folder).select("archivo", "turn_no", F.col("text").alias("texto"))
    return semantic.chunk_turns(spoken, I.CHUNKING)


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    return semantic.best_match(I.vector_chunks(spark, folder), I.label_centroids(spark, folder))


def semantic_top1(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder).select(
        F.col("turn_no").alias("vec_id"), "cat_id", "frase", F.round("similarity", 6).alias("similarity")
    )


def detections(spark: SparkSession, folder: str) -> DataFrame:
    return semantic.ordered(semantic.detections(_scored(spark, folder), I.THRESHOLD)).drop("chunk_no")


def prompt_texts(spark: SparkSession, folder: str) -> DataFrame:
    found = I.document_detections(spark, folder)
    return found.select(
        "doc_id",
        prompts.objection_prompt(I.TEMPLATE, found.columns).alias("prompt"),
        prompts.summary_prompt(F.col("frase_original"), I.INSTRUCTION).alias("summary_prompt"),
    )


def validated(spark: SparkSession, folder: str) -> DataFrame:
    reviewed = scoring.apply_answers(
        I.document_detections(spark, folder), I.stored_answers(spark, folder), I.KEYWORDS, ["doc_id"]
    )
    return tables.order_columns(
        scoring.keep_validated(reviewed), ["archivo_origen", "categoria", "no_such_column", "respuesta_llm"]
    )


def _final(spark: SparkSession, folder: str) -> DataFrame:
    all_turns = I.conversation_turns(spark, folder)
    objections = rules.rule_objections(turns.client_turns(all_turns, 1), I.RULES)
    found = objections.select(
        F.concat(F.lit(" "), "archivo").alias("archivo_origen"),
        "turn_no",
        "rule_no",
        F.col("full_text").alias("frase_original"),
        F.concat("type", F.lit(", "), "category", F.lit(",,")).alias("categoria"),
        F.when(F.col("intensity") >= 2, "si").when(F.col("intensity") == 1, "no").alias("exito"),
    )
    told = I.table(spark, folder, "documents").select(
        F.concat(F.lit("call_"), F.col("doc_id"), F.lit(" \n")).alias("archivo"),
        F.when(F.col("lang") == "de", "").otherwise(F.col("text")).alias("resumen"),
    )
    return calls.final_calls(_metrics(all_turns), found, scoring.drop_empty_summaries(told))


def final_calls(spark: SparkSession, folder: str) -> DataFrame:
    return _final(spark, folder)


def call_kpis(spark: SparkSession, folder: str) -> DataFrame:
    return dashboard.kpis_by_call(_final(spark, folder))


def per_call_means(spark: SparkSession, folder: str) -> DataFrame:
    return dashboard.per_call_means(calls.named_calls(_metrics(I.conversation_turns(spark, folder))))


def category_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return dashboard.category_distribution(_final(spark, folder))


def _reports(spark: SparkSession, folder: str) -> DataFrame:
    matched = rules.match_rules(I.conversation_turns(spark, folder), I.RULES, 1)
    return reports.call_report(matched, I.RULES.types, 1)


def call_report(spark: SparkSession, folder: str) -> DataFrame:
    entries = F.array_sort(F.map_entries("objection_types"))
    listed = F.transform(entries, lambda e: F.concat(e["key"], F.lit(":"), e["value"]))
    return _reports(spark, folder).select(
        "file",
        "total_turns",
        "client_turns",
        "objections_found",
        F.array_join(listed, ",").alias("objection_types"),
        F.array_join("type_order", ">").alias("type_order"),
        F.round("avg_intensity", 6).alias("avg_intensity"),
    )


def corpus_stats(spark: SparkSession, folder: str) -> DataFrame:
    stats = reports.corpus_stats(_reports(spark, folder), I.RULES.types)
    return stats.select(
        "total_files",
        "total_objections",
        F.round("avg_objections_per_file", 6).alias("avg_objections_per_file"),
        "most_common_objection",
        F.round("overall_avg_intensity", 6).alias("overall_avg_intensity"),
    )


def run_counts(spark: SparkSession, folder: str) -> DataFrame:
    return semantic.run_counts(_scored(spark, folder), I.THRESHOLD).drop("failed")


def review_counts(spark: SparkSession, folder: str) -> DataFrame:
    reviewed = scoring.apply_answers(
        I.document_detections(spark, folder), I.stored_answers(spark, folder), I.KEYWORDS, ["doc_id"]
    )
    return scoring.review_counts(reviewed)


def call_list(spark: SparkSession, folder: str) -> DataFrame:
    return dashboard.call_list(calls.named_calls(_metrics(I.conversation_turns(spark, folder))))


def phrase_detail(spark: SparkSession, folder: str) -> DataFrame:
    return dashboard.phrase_detail(_final(spark, folder))


def report_documents(spark: SparkSession, folder: str) -> DataFrame:
    matched = rules.match_rules(I.conversation_turns(spark, folder), I.RULES, 1)
    return _flat_documents(reports.document_parts(matched))


def _flat_documents(parts: DataFrame) -> DataFrame:
    details = F.transform(
        "objections",
        lambda o: F.concat_ws("|", o["type"], o["matched_text"], o["timestamp"], o["context_before"], o["context_after"]),
    )
    said = F.transform("turns", lambda t: F.concat_ws("|", t["speaker"], t["timestamp"], t["text"]))
    return parts.select(
        "file",
        "part",
        F.size("objections").alias("objections_found"),
        F.array_join(details, "\n").alias("objections"),
        F.array_join(said, "\n").alias("turns"),
    )


def counts_from_objections(spark: SparkSession, folder: str) -> DataFrame:
    all_turns = I.conversation_turns(spark, folder)
    found = rules.rule_objections(turns.client_turns(all_turns, 1), I.RULES)
    levels = spark.createDataFrame(
        [(name, level) for name, level in I.RULES.intensity.items()], "category string, intensity int"
    )
    rated = rules.with_intensity(found, levels)
    counts = reports.call_counts(all_turns, rated, 1)
    types = reports.type_counts(rated)
    listed = F.transform(
        F.array_sort(F.map_entries("objection_types")), lambda e: F.concat(e["key"], F.lit(":"), e["value"])
    )
    return counts.join(types, "archivo", "left").select(
        "archivo",
        "total_turns",
        "client_turns",
        "objections_found",
        F.coalesce(F.array_join(listed, ","), F.lit("")).alias("objection_types"),
        F.round("avg_intensity", 6).alias("avg_intensity"),
    )


def preview(spark: SparkSession, folder: str) -> DataFrame:
    final = _final(spark, folder).orderBy("archivo", "turn_no", "rule_no")
    return dashboard.preview(final.select("archivo", "turn_no", "rule_no", "duracion_total_seg", "categoria"))


def renumbered_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Client turns numbered anew, as if the other speakers had never been there."""
    mine = turns.client_turns(I.conversation_turns(spark, folder), 1).withColumnRenamed("turn_no", "place")
    return turns.number_turns(mine.select("archivo", "place", "text"), "place")


def _detected(spark: SparkSession, folder: str) -> DataFrame:
    transcripts = I.conversation_transcripts(spark, folder)
    pieces = detection.clean_and_chunk(transcripts, I.CLEANING, I.CHUNKING)
    whole = pieces.select("archivo", "turn_no", "chunk_no", "chunk")
    return detection.detect(whole, I.RULES, I.make_encoder, I.LETTER_THRESHOLD)[0]


def semantic_detection(spark: SparkSession, folder: str) -> DataFrame:
    return _detected(spark, folder)


def reviewed_detection(spark: SparkSession, folder: str) -> DataFrame:
    return detection.validate(
        _detected(spark, folder), I.answer_by_length, I.TEMPLATE, I.KEYWORDS, ["archivo_origen", "similitud"]
    )


def scored_sentiment(spark: SparkSession, folder: str) -> DataFrame:
    timed = turns.with_duration(I.conversation_turns(spark, folder).select("archivo", "turn_no", "speaker", "start_sec", "text"))
    return calls.call_metrics(scoring.label_sentiment(timed, I.make_classifier, "text"))


def summaries(spark: SparkSession, folder: str) -> DataFrame:
    texts = I.table(spark, folder, "documents").select(
        F.concat(F.lit("call_"), F.col("doc_id")).alias("archivo"), F.col("text").alias("raw")
    )
    told, _ = scoring.summarise(texts, I.summary_by_length, I.INSTRUCTION)
    return told


def dashboard_columns(spark: SparkSession, folder: str) -> DataFrame:
    """The metrics under names as a hand-made export has them, brought back to plain ones."""
    metrics = _metrics(I.conversation_turns(spark, folder))
    names = [f" {name.replace('_t', '_T')} " for name in metrics.columns]
    names[:2] = [" Archivó ", "Duración_Total_Seg"]
    return tables.normalise_columns(metrics.toDF(*names))


def clean_sink(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_folder(spark, "clean")
    write_clean(parsing.clean_call(I.conversation_transcripts(spark, folder), I.CLEANING), path)
    return spark.read.schema("archivo string, clean string").parquet(path)


def _delimited(spark: SparkSession, folder: str) -> tuple[str, str]:
    """Place and schema of the final table as delimited text."""
    path, final = fresh_folder(spark, "final"), _final(spark, folder)
    tables.write_final(final, path)
    return path, ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in final.schema)


def delimited_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return tables.read_table(spark, *_delimited(spark, folder))


def split_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """The same table, its files cut into ranges of ``CUT`` bytes that are read apart."""
    return splitting.split_table(spark, *_delimited(spark, folder), range_bytes=CUT)


def detection_files(spark: SparkSession, folder: str) -> DataFrame:
    path, found = fresh_folder(spark, "detections"), semantic.detections(_scored(spark, folder), I.THRESHOLD)
    found.write.json(path)
    return tables.read_detections(spark, path, json_lines=True)


def report_sink(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_folder(spark, "reports")
    matched = rules.match_rules(I.conversation_turns(spark, folder), I.RULES, 1)
    parts = reports.document_parts(matched)
    write_reports(parts, path)
    return _flat_documents(spark.read.schema(parts.schema).json(path))


def objection_job(spark: SparkSession, folder: str) -> DataFrame:
    """The rule job from transcripts, as rows."""
    return objections.list_objections(I.conversation_transcripts(spark, folder), I.RULES)


def report_job(spark: SparkSession, folder: str) -> DataFrame:
    """The rule job from transcripts, as nested reports with the client of each call, without turns."""
    known = I.special_clients(I.conversation_turns(spark, folder))
    transcripts = I.conversation_transcripts(spark, folder).join(known, "archivo", "left")
    options = ReportOptions(include_turns=False)
    made = objections.analyse_calls(transcripts, I.RULES, options, client="client")
    entries = F.transform(
        F.array_sort(F.map_entries("objection_types")), lambda e: F.concat(e["key"], F.lit(":"), e["value"])
    )
    details = F.transform(
        "objections",
        lambda o: F.concat_ws("|", o["type"], o["matched_text"], o["timestamp"], o["context_before"], o["context_after"]),
    )
    return made.select(
        "file",
        "total_turns",
        "client_turns",
        "objections_found",
        F.array_join(entries, ",").alias("objection_types"),
        F.round("avg_intensity", 6).alias("avg_intensity"),
        F.array_join(details, "\n").alias("objections"),
    )


def corpus_job(spark: SparkSession, folder: str) -> DataFrame:
    """The rule job from transcripts, summed up; calls without turns count."""
    stats = objections.analyse_corpus(I.sparse_transcripts(spark, folder), I.RULES)
    return stats.select("total_files", "total_objections", F.round("avg_objections_per_file", 6).alias("mean"))


def metrics_job(spark: SparkSession, folder: str) -> DataFrame:
    """The metrics job from transcripts in which some turns are silent and some calls have none."""
    return call_jobs.measure_calls(I.sparse_transcripts(spark, folder), I.make_classifier)


def folder_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Documents written as files and read back; those of one source come in another encoding and are rejects."""
    good, rejects = with_rejects(read_transcripts(spark, _document_files(spark, folder)))
    return _scan_report(good.withColumn("parse_error", F.lit(None).cast("string")).unionByName(rejects))


def folder_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The same files as a stream that runs until all is read, appended to a table."""
    table = fresh_folder(spark, "streamed")
    stream = folders.stream_transcripts(spark, _document_files(spark, folder), seen=fresh_folder(spark, "seen"))
    folders.append_to(stream, table, fresh_folder(spark, "progress")).awaitTermination()
    return _scan_report(spark.read.schema("archivo string, raw string, parse_error string").parquet(table))


def _document_files(spark: SparkSession, folder: str) -> str:
    """Files of the documents of a source, a language and a block of ids each, so that none grows with the table."""
    path = fresh_folder(spark, "files")
    docs = I.table(spark, folder, "documents")
    latin = F.encode(F.regexp_replace("text", r"[^\x00-\xFF]", "?"), "ISO-8859-1")
    text = F.when(F.col("source") == I.OTHER_ENCODING, latin).otherwise(F.col("text").cast("binary"))
    block = F.floor(F.col("doc_id") / I.FILE_DOCS)
    part = F.concat_ws("-", "source", "lang", block.cast("string")).alias("part")
    write_files(docs.select(text.alias("value"), part), path)
    return f"{path}/*"


def _scan_report(files: DataFrame) -> DataFrame:
    return files.groupBy("parse_error").agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(F.length("raw")), F.lit(0)).alias("chars")
    )


def growing_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Corpus statistics, categories and run counters of a table of calls that grows twice, each figure in a row."""
    table, path, checkpoint = (fresh_folder(spark, name) for name in ("arriving", "totals", "progress"))
    wanted = {
        "corpus": totals.corpus(I.RULES),
        "categories": totals.categories(_ruled_final),
        "runs": totals.runs(_scored_chunks, I.LETTER_THRESHOLD),
    }
    transcripts = I.conversation_transcripts(spark, folder).withColumn("parse_error", F.lit(None).cast("string"))
    arrival = F.pmod(F.xxhash64("archivo"), F.lit(3))
    for k in range(3):
        transcripts.where(arrival == k).write.mode("append").parquet(table)
        stream = spark.readStream.schema("archivo string, raw string, parse_error string").parquet(table)
        totals.follow(stream, wanted, path, checkpoint).awaitTermination()
    found = {name: totals.figures(spark, total, path, name) for name, total in wanted.items()}

    def rows(name: str) -> DataFrame:
        shown = [F.round(c, 6) if kind == "double" else F.col(c) for c, kind in found[name].dtypes]
        named = [F.struct(F.lit(c).alias("figure"), v.cast("string").alias("value")) for c, v in zip(found[name].columns, shown)]
        return found[name].select(F.lit(name).alias("total"), F.inline(F.array(*named)))

    by_category = found["categories"].select(F.lit("categories"), "categoria", F.col("cantidad").cast("string"))
    return rows("corpus").union(rows("runs")).union(by_category)


def _scored_chunks(transcripts: DataFrame) -> DataFrame:
    return detection.score(detection.clean_and_chunk(transcripts, I.CLEANING, I.CHUNKING), I.RULES, I.make_encoder)


def _ruled_final(transcripts: DataFrame) -> DataFrame:
    """The final table of calls whose detections are their rule objections, without summaries."""
    found = objections.list_objections(transcripts, I.RULES).select(
        F.col("archivo").alias("archivo_origen"), F.concat("type", F.lit(", "), "category", F.lit(",,")).alias("categoria")
    )
    told = transcripts.select("archivo", F.lit("").alias("resumen"))
    return calls.final_calls(call_jobs.measure_calls(transcripts, I.make_classifier), found, scoring.drop_empty_summaries(told))


def one_call(spark: SparkSession, folder: str) -> DataFrame:
    """The dashboard's figures of the first call by name, one row each."""
    final = settle(_final(spark, folder))
    name = final.agg(F.min("archivo")).first()[0]
    head = dashboard.call_kpis(final, name)
    figures = [
        head.select(F.lit("id").alias("figure"), F.col("id_llamada").alias("value")),
        head.select(F.lit("exito"), F.col("exito")),
        head.select(F.lit("sentimiento"), F.col("sentimiento_prom").cast("string")),
        head.select(F.lit("minutos"), F.col("duracion_prom_min").cast("string")),
        dashboard.success_flag(final, name).select(F.lit("flag"), "exito"),
        dashboard.success_flag(final).select(F.lit("flag of all"), "exito"),
        dashboard.sentiment_kpi(final, name).select(F.lit("sentiment"), F.col("sentimiento_prom").cast("string")),
        dashboard.duration_kpi(final, name).select(F.lit("minutes"), F.col("duracion_prom_min").cast("string")),
        dashboard.call_summary(final).select(F.lit("summary of all"), "resumen"),
        dashboard.phrase_detail(final, name).agg(F.lit("phrases"), F.count("frase_original").cast("string")),
    ]
    return reduce(DataFrame.union, figures)


def detection_array(spark: SparkSession, folder: str) -> DataFrame:
    """Detections as JSON arrays, one file per call and block of ``ARRAY_BLOCK`` vector numbers."""
    path = _detection_arrays(spark, folder)
    return tables.read_detections(spark, path).drop("call", "block")


def split_arrays(spark: SparkSession, folder: str) -> DataFrame:
    """The same arrays, each cut into ranges of ``CUT`` bytes that are read apart."""
    return splitting.split_json(spark, _detection_arrays(spark, folder), schemas.DETECTIONS, CUT)


def _detection_arrays(spark: SparkSession, folder: str) -> str:
    path = fresh_folder(spark, "arrays")
    found = semantic.detections(_scored(spark, folder), I.THRESHOLD)
    names = [c for c in found.columns if c not in ("turn_no", "chunk_no")]
    block = F.floor(F.col("turn_no") / ARRAY_BLOCK).alias("block")
    rows = found.groupBy("archivo_origen", block).agg(F.to_json(F.array_sort(F.collect_list(F.struct(*names)))).alias("value"))
    rows.select("value", F.regexp_replace("archivo_origen", "[^a-z0-9_]", "").alias("call"), "block").repartition(
        "call", "block"
    ).write.partitionBy("call", "block").text(path)
    return path


def united_detections(spark: SparkSession, folder: str) -> DataFrame:
    """Detections of two folders, one of which has no places."""
    found = semantic.detections(_scored(spark, folder), I.THRESHOLD)
    return semantic.union_detections(found, found.drop("chunk_no"))


def comma_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks with a caller's sentence splitter."""
    spoken = I.conversation_turns(spark, folder).select("archivo", "turn_no", F.col("text").alias("texto"))
    return semantic.chunk_turns(spoken, I.CHUNKING, semantic.split_with(I.split_at_commas))


def failed_encodings(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of a run in which the encoder fails on some chunks: they stay counted."""
    pieces = detection.clean_and_chunk(I.conversation_transcripts(spark, folder), I.CLEANING, I.CHUNKING)
    scored = detection.score(pieces, I.RULES, I.make_fussy_encoder, I.make_encoder)
    return semantic.run_counts(scored, I.LETTER_THRESHOLD).select("archivo", "chunks", "failed")


def small_catalog_slices(spark: SparkSession, folder: str) -> DataFrame:
    """The best match with a catalog that is sent in many slices: the same rows as in one."""
    scored = semantic.best_match(I.vector_chunks(spark, folder), I.label_centroids(spark, folder), slice_bytes=1500)
    return scored.select(
        F.col("turn_no").alias("vec_id"), "cat_id", "frase", F.round("similarity", 6).alias("similarity")
    )


def resumed_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Questions on all documents in two jobs that share a store; the second asks what the first did not, or failed on."""
    store = AnswerStore(spark, fresh_folder(spark, "answers"))
    prompt = prompts.summary_prompt(F.col("text"), I.INSTRUCTION)
    asked = I.table(spark, folder, "documents").select("doc_id", "lang", prompt.alias("prompt"))
    asked = asked.withColumn("prompt_key", F.sha2("prompt", 256))
    first = scoring.answer_prompts(asked.where(F.col("lang") == I.FIRST_LANG), I.answer_by_length, store=store)
    last_run = first.agg(F.max("run")).first()[0]
    answers = scoring.answer_prompts(asked, I.answer_by_length, store=store)
    job = F.when(F.col("run") <= last_run, 1).otherwise(2).alias("job")
    return asked.join(answers, "prompt_key").select("doc_id", "answer", F.col("error").isNotNull().alias("failed"), job)


def published_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Cleaned calls published in parts of which one comes twice, over a table that the first part replaces."""
    place = fresh_folder(spark, "published")
    cleaned = parsing.clean_call(I.conversation_transcripts(spark, folder), I.CLEANING).select("archivo", "clean")
    part = F.pmod(F.xxhash64("archivo"), F.lit(3))
    publish(cleaned.withColumn("clean", F.lit("old")), place, run="old")
    for run, append in ((0, False), (1, True), (1, True), (2, True)):
        publish(cleaned.where(part == run), place, run=f"part {run}", append=append)
    return read_published(spark, place, "archivo string, clean string")


def pruned_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """The vectors of odd labels matched against those of even labels as a catalog of many entries."""
    entries = I.table(spark, folder, "embeddings").where("label % 2 = 0").selectExpr(
        "CAST(vec_id AS int) AS cat_id", "concat('phrase ', vec_id) AS frase", "'EVEN' AS categoria",
        "concat('t', label) AS tipo", "embedding",
    )
    asked = I.vector_chunks(spark, folder).where("CAST(substr(archivo, 6) AS int) % 2 = 1")
    return catalogs.pruned_match(asked, entries).select(
        F.col("turn_no").alias("vec_id"), "cat_id", "tipo", F.round("similarity", 6).alias("similarity")
    )


def long_transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """Files that hold the transcripts of a block of calls one after the other, read as long calls in many ranges."""
    path = fresh_folder(spark, "recordings")
    calls_ = I.conversation_transcripts(spark, folder).withColumn("call", F.substr("archivo", F.lit(6)).cast("long"))
    raw = F.replace("raw", F.lit(I.PREAMBLE), F.lit(""))
    rows = calls_.select(raw.alias("raw"), "call", F.floor(F.col("call") / I.FILE_DOCS).alias("part"))
    ordered = rows.repartition("part").sortWithinPartitions("part", "call")
    ordered.select("raw", "part").write.partitionBy("part").text(path)
    found, _ = read_long_turns(spark, f"{path}/*", min_bytes=0, range_bytes=CUT)
    part = F.regexp_extract("path", "part=([0-9]+)", 1).cast("long").alias("part")
    return found.select(part, "turn_no", "speaker", "speaker_num", "timestamp", "start_sec", "text")


QUERIES = {
    "q01_turn_parse_full": turn_parse_full,
    "q02_turn_parse_clean": turn_parse_clean,
    "q03_turn_parse_metrics": turn_parse_metrics,
    "q04_clean_call": clean_call,
    "q05_clean_text": clean_text,
    "q06_fold_vowels": fold_vowels,
    "q07_catalog": catalog,
    "q08_context": context,
    "q09_rule_objections": rule_objections,
    "q10_talk_time_sentiment": talk_time_sentiment,
    "q11_chunks": chunks,
    "q12_semantic_top1": semantic_top1,
    "q13_detections": detections,
    "q14_prompts": prompt_texts,
    "q15_validated": validated,
    "q16_final_calls": final_calls,
    "q17_call_kpis": call_kpis,
    "q17b_per_call_means": per_call_means,
    "q18_category_distribution": category_distribution,
    "q19_call_report": call_report,
    "q19b_counts_from_objections": counts_from_objections,
    "q20_corpus_stats": corpus_stats,
    "q21_run_counts": run_counts,
    "q21b_review_counts": review_counts,
    "q22_call_list": call_list,
    "q23_phrase_detail": phrase_detail,
    "q24_report_documents": report_documents,
    "q25_preview": preview,
    "q26_semantic_detection": semantic_detection,
    "q27_reviewed_detection": reviewed_detection,
    "q28_scored_sentiment": scored_sentiment,
    "q29_summaries": summaries,
    "q30_renumbered_turns": renumbered_turns,
    "q31_dashboard_columns": dashboard_columns,
    "q32_clean_sink": clean_sink,
    "q33_delimited_round_trip": delimited_round_trip,
    "q34_detection_files": detection_files,
    "q35_report_sink": report_sink,
    "q36_objection_job": objection_job,
    "q37_report_job": report_job,
    "q38_corpus_job": corpus_job,
    "q39_metrics_job": metrics_job,
    "q40_folder_scan": folder_scan,
    "q41_folder_stream": folder_stream,
    "q42_one_call": one_call,
    "q43_detection_array": detection_array,
    "q44_united_detections": united_detections,
    "q45_comma_chunks": comma_chunks,
    "q46_failed_encodings": failed_encodings,
    "q47_sliced_catalog": small_catalog_slices,
    "q48_growing_totals": growing_totals,
    "q49_split_arrays": split_arrays,
    "q50_split_table": split_round_trip,
    "q51_resumed_answers": resumed_answers,
    "q52_published_clean": published_clean,
    "q53_pruned_catalog": pruned_catalog,
    "q54_long_transcripts": long_transcripts,
}
