"""Schemas of the tables that are read from files, and of nested values."""

RULES = (
    "type string, category string, type_ord int, category_ord int, pattern_ord int, "
    "pattern string"
)

DETECTIONS = (
    "archivo_origen string, frase_original string, patron_mas_cercano string, "
    "categoria string, tipo string, similitud double"
)

VALIDATED = DETECTIONS + ", respuesta_llm string, validado_llm boolean"

CALL_METRICS = (
    "duracion_total_seg int, tiempo_speaker1_seg int, tiempo_speaker2_seg int, "
    "sentimiento_speaker1 double, sentimiento_speaker2 double, archivo string"
)

SUMMARIES = "archivo string, resumen string"

HIT = (
    "struct<rule_no:int,type:string,category:string,intensity:int,matched_text:string,pattern:string>"
)
