"""Text-generator extension point: message lists in, answers or in-band errors out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from marginalia.functions.vocabulary import GENERATOR_ERROR_PREFIX


def generate_answers(requests: DataFrame, generator: Callable[[list[dict]], str], key: str = "query_id") -> DataFrame:
    """``(key, messages)`` to ``(key, answer)``. The generator runs in the workers; an exception becomes an
    answer with the error prefix, so one failure does not stop the others."""
    schema = f"{key} {requests.schema[key].dataType.simpleString()}, answer STRING"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            answers = []
            for messages in pdf["messages"]:
                try:
                    answers.append(generator([{"role": m["role"], "content": m["content"]} for m in messages]))
                except Exception as exc:
                    answers.append(f"{GENERATOR_ERROR_PREFIX} {type(exc).__name__}]")
            yield pd.DataFrame({key: pdf[key], "answer": answers})
    return requests.select(key, "messages").mapInPandas(run, schema)
