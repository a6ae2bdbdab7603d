"""The reporting questions asked of the final table of calls."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tertulia.functions.text import split_categories
from tertulia.sources.staging import settle

# Names shown when no single call is selected, and the two outcomes.
ALL_CALLS = "Todas"
SEVERAL = "Varias"
SEVERAL_SUMMARIES = "Múltiples llamadas"
SUCCESS_MARK = "si"
SUCCESS, FAILURE = "Sí", "No"


def select_call(final: DataFrame, archivo: str = ALL_CALLS) -> DataFrame:
    return final if archivo == ALL_CALLS else final.where(F.col("archivo") == archivo)


def call_list(calls: DataFrame) -> DataFrame:
    """The choice of all calls, then each call name once in ascending order.

    Takes the final table or, which saves its joins, the calls under their final names.
    """
    names = calls.select("archivo").where("archivo is not null").distinct()
    everything = calls.sparkSession.createDataFrame([(ALL_CALLS,)], "archivo string")
    ranked = everything.withColumn("_rank", F.lit(0)).union(names.withColumn("_rank", F.lit(1)))
    return ranked.orderBy("_rank", "archivo").select("archivo")


def _success() -> Column:
    share = F.avg(F.coalesce(F.col("exito") == SUCCESS_MARK, F.lit(False)).cast("int"))
    return F.when(share > 0.5, SUCCESS).otherwise(FAILURE)


def _kpis_of(columns: Sequence[str], mean: Callable[[str], Column]) -> list[Column]:
    """The two head figures from the mean of each column."""
    absent = F.lit(None).cast("double")
    sentiment, minutes = absent, absent
    if {"sentimiento_speaker1", "sentimiento_speaker2"} <= set(columns):
        sentiment = F.round((mean("sentimiento_speaker1") + mean("sentimiento_speaker2")) / 2, 3)
    if "duracion_total_seg" in columns:
        minutes = F.round(mean("duracion_total_seg") / 60, 2)
    return [sentiment.alias("sentimiento_prom"), minutes.alias("duracion_prom_min")]


def _kpis(columns: Sequence[str]) -> list[Column]:
    """Means over the rows of the final table, where a call counts once per detection."""
    return _kpis_of(columns, F.avg)


def _first_summary(columns: Sequence[str], order: Sequence[str]) -> Column:
    """Summary of the first row by the order columns that exist; by its own text when there are none."""
    places = [name for name in order if name in columns]
    return F.min_by("resumen", F.struct(*places)) if places else F.min("resumen")


def success_flag(final: DataFrame, archivo: str = ALL_CALLS) -> DataFrame:
    if archivo == ALL_CALLS:
        return final.agg(F.lit(SEVERAL).alias("exito"))
    return select_call(final, archivo).agg(_success().alias("exito"))


def sentiment_kpi(final: DataFrame, archivo: str = ALL_CALLS) -> DataFrame:
    return select_call(final, archivo).agg(_kpis(final.columns)[0])


def duration_kpi(final: DataFrame, archivo: str = ALL_CALLS) -> DataFrame:
    return select_call(final, archivo).agg(_kpis(final.columns)[1])


def call_summary(
    final: DataFrame, archivo: str = ALL_CALLS, order: Sequence[str] = ("turn_no", "rule_no", "chunk_no")
) -> DataFrame:
    if archivo == ALL_CALLS:
        return final.agg(F.lit(SEVERAL_SUMMARIES).alias("resumen"))
    return select_call(final, archivo).agg(_first_summary(final.columns, order).alias("resumen"))


def call_kpis(
    final: DataFrame, archivo: str = ALL_CALLS, order: Sequence[str] = ("turn_no", "rule_no", "chunk_no")
) -> DataFrame:
    """The selected call's head figures in one row: ``id_llamada, exito, sentimiento_prom, ...``."""
    rows = select_call(final, archivo)
    if archivo == ALL_CALLS:
        head = [F.lit(SEVERAL).alias("id_llamada"), F.lit(SEVERAL).alias("exito")]
        summary = F.lit(SEVERAL_SUMMARIES)
    else:
        head = [F.lit(archivo).alias("id_llamada"), _success().alias("exito")]
        summary = _first_summary(final.columns, order)
    return rows.agg(
        *_kpis(final.columns), *[h for h in head[1:]], summary.alias("resumen")
    ).select(head[0], "exito", "sentimiento_prom", "duracion_prom_min", "resumen")


def _row_place(order: Sequence[str]) -> Column:
    """The order columns of a row as one number, missing values first."""
    place = F.lit(0).cast("decimal(38,0)")
    for name in order:
        number = F.coalesce(F.col(name).cast("long") + 1, F.lit(0)).cast("decimal(19,0)")
        place = (place * F.lit(1 << 33).cast("decimal(11,0)")).cast("decimal(38,0)") + number
    return place.cast("decimal(38,0)")


def _first_summaries(final: DataFrame, firsts: DataFrame, order: Sequence[str]) -> DataFrame:
    """``_call, resumen`` of the first row of each call, the least text where several rows are first; ``firsts`` has
    ``archivo, _first``. Only those rows' texts are moved."""
    told = final.select(F.col("archivo").alias("_call"), _row_place(order).alias("_place"), "resumen")
    first = told.join(firsts, F.col("archivo").eqNullSafe(F.col("_call")) & (F.col("_place") == F.col("_first")))
    texts = first.select("_call", "resumen").distinct()
    by_text = Window.partitionBy("_call").orderBy(F.asc_nulls_last("resumen"))
    return texts.withColumn("_rank", F.row_number().over(by_text)).where("_rank = 1").drop("_rank")


def kpis_by_call(
    final: DataFrame, order: Sequence[str] = ("turn_no", "rule_no", "chunk_no")
) -> DataFrame:
    """``call_kpis`` of every call, and of all calls together.

    The numbers of a call are summed up once, by hashing; the figures of all calls come from those sums. Summaries are
    fetched afterwards, for the first row of each call. Runs a job.
    """
    measured = [c for c in ("sentimiento_speaker1", "sentimiento_speaker2", "duracion_total_seg") if c in final.columns]
    places = [name for name in order if name in final.columns]
    sums = [f(c).alias(f"_{f.__name__}_{c}") for c in measured for f in (F.sum, F.count)]
    said_yes = F.coalesce(F.col("exito") == SUCCESS_MARK, F.lit(False)).cast("int")
    calls = settle(
        final.groupBy("archivo").agg(*sums, F.avg(said_yes).alias("_share"), F.min(_row_place(places)).alias("_first"))
    )
    summed = [F.sum(f"_{f}_{c}").alias(f"_{f}_{c}") for c in measured for f in ("sum", "count")]
    together = calls.agg(F.count(F.lit(1)).alias("_calls"), *summed).where("_calls > 0")

    def means(rows: DataFrame, *head: Column) -> DataFrame:
        return rows.select(*head, *((F.col(f"_sum_{c}") / F.col(f"_count_{c}")).alias(c) for c in measured))

    told = _first_summaries(final, calls.select("archivo", "_first"), places)
    each = calls.join(told, F.col("archivo").eqNullSafe(F.col("_call")), "left")
    success = F.when(F.col("_share") > 0.5, SUCCESS).otherwise(FAILURE)
    every = means(each, F.col("archivo").alias("id_llamada"), success.alias("exito"), F.col("resumen"))
    one = (F.lit(v).alias(n) for n, v in (("id_llamada", SEVERAL), ("exito", SEVERAL), ("resumen", SEVERAL_SUMMARIES)))
    figures = every.unionByName(means(together, *one))
    return figures.select("id_llamada", "exito", *_kpis_of(measured, F.col), "resumen")


def per_call_means(calls: DataFrame) -> DataFrame:
    """The two means with every call counted once, beside the means over detection rows.

    Takes the final table or, which saves its joins, the calls under their final names.
    """
    once = calls.groupBy("archivo").agg(
        F.max("sentimiento_speaker1").alias("sentimiento_speaker1"),
        F.max("sentimiento_speaker2").alias("sentimiento_speaker2"),
        F.max("duracion_total_seg").alias("duracion_total_seg"),
    )
    return once.agg(*_kpis(once.columns))


def category_distribution(final: DataFrame, archivo: str = ALL_CALLS) -> DataFrame:
    """Rows per name in the comma-separated ``categoria`` lists."""
    names = F.explode(split_categories(F.col("categoria"))).alias("categoria")
    return (
        select_call(final, archivo).select(names).groupBy("categoria").agg(F.count(F.lit(1)).alias("cantidad"))
    )


def phrase_detail(final: DataFrame, archivo: str = ALL_CALLS) -> DataFrame:
    return select_call(final, archivo).select("frase_original", "categoria")


def preview(df: DataFrame, rows: int = 5) -> DataFrame:
    return df.limit(rows)
