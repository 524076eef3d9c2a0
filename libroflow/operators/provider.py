"""Model requests: conversations built by expressions, and the seam through which a provider answers them.

No network client belongs here. `replay` answers from stored responses by the request's hash; `answered` hands the
requests to any callable, batch by batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def conversations(df: DataFrame, instructions: Column, examples: Column, question: Column, out: str = "messages") -> DataFrame:
    """System messages, then example questions with their answers, then the question, in order."""
    system = F.transform(instructions, lambda x: message("system", x))
    shots = F.flatten(F.transform(examples, lambda e: F.array(message("user", e["raw"]), message("assistant", e["answer"]))))
    return df.withColumn(out, F.concat(system, shots, F.array(message("user", question))))


def request_hash(messages: Column) -> Column:
    return F.sha2(F.to_json(messages), 256)


def replay(requests: DataFrame, stored: DataFrame, messages: str = "messages", out: str = "answer") -> DataFrame:
    """Answers stored under the request's hash (columns request, answer); null where there is none."""
    side = stored.groupBy("request").agg(F.min("answer").alias(out))
    return requests.withColumn("request", request_hash(F.col(messages))).join(side, "request", "left")


def answered(requests: DataFrame, key: str, provider: Callable[[list[list[dict]]], list[str | None]], messages: str = "messages") -> DataFrame:
    """(key, answer, error) from a provider that answers lists of conversations; where it fails the answer is null, as in the
    pipeline this follows, and the error says why."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            chats = [[{"role": m["role"], "content": m["content"]} for m in x] for x in pdf[messages]]
            try:
                answers, error = provider(chats), None
            except Exception as e:  # whatever a provider raises
                answers, error = [None] * len(chats), f"{type(e).__name__}: {e}"
            yield pd.DataFrame({key: pdf[key], "answer": answers, "error": error})

    kind = dict(requests.dtypes)[key]
    return requests.select(key, messages).mapInPandas(run, f"{key} {kind}, answer string, error string")


def rgb_url(url: Column) -> Column:
    """The address of an image's colour copy: `-rgb.jpg` in place of the file's extension."""
    return F.concat(F.regexp_replace(url, r"\.[^./]*$", ""), F.lit("-rgb.jpg"))


def fine_tuning_records(df: DataFrame, instructions: Column, question: Column, answer: Column) -> DataFrame:
    """One JSON line per example, as fine-tuning expects it."""
    chat = F.concat(F.transform(instructions, lambda x: message("system", x)), F.array(message("user", question), message("assistant", answer)))
    return df.select(F.to_json(F.struct(chat.alias("messages"))).alias("value"))
