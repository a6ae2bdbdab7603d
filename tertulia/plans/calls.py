"""Transcripts to call metrics, and metrics, detections and summaries to the final table."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from tertulia.operators.calls import call_metrics, final_calls
from tertulia.operators.parsing import parse_metric_turns
from tertulia.operators.scoring import label_sentiment

Classifier = Callable[[], Callable[[np.ndarray], np.ndarray]]


def measure_calls(calls: DataFrame, make_classifier: Classifier, batch_size: int = 8) -> DataFrame:
    """Metrics per call. Durations come from the parse; only sums per call are exchanged.

    Calls the classifier fails on have ``parse_error`` set; ``with_rejects`` takes them out.
    """
    timed = parse_metric_turns(calls.select("archivo", "raw"))
    labelled = label_sentiment(timed, make_classifier, "speech", batch_size)
    return call_metrics(labelled, check_labels=True)


def final_table(metrics: DataFrame, validated: DataFrame, summaries: DataFrame) -> DataFrame:
    return final_calls(metrics, validated, summaries)
