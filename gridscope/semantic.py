"""Where a language model may add findings.

A provider gets small candidate tables (columns, headers, distinct values) and returns
those rows of which its question holds, with a confidence; rules use rows of ``SURE`` and
more. Without a provider the rules keep the confidences that they have without a model.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Fixed value: the least confidence of an answer that counts.
SURE = 0.7

#: What is asked of the rows of each kind of candidates.
QUESTIONS = {
    "zero_unlikely": "In this numeric column blanks stand beside zeros. Is it unlikely that a blank means zero?",
    "infer_units": "Does this column name make its unit clear, though it names none?",
    "unit_cells": "Does this value of a numeric column hold a unit or other text beside its number?",
    "other_details": "Is this answer a detail that was given for another one, and no choice of its own?",
    "abbreviations": "Does this value of a label column stand for the one above it?",
    "wide_format": "Do these column names repeat one measure for several times or categories?",
    "variants": "Are these two answers one answer, spelt differently?",
    "header_clarity": "Is this column name unclear to a reader who knows only the table?",
}


class NoProvider:
    """Finds nothing."""

    def available(self) -> bool:
        return False

    def ask(self, kind: str, candidates: DataFrame) -> DataFrame:
        return candidates.limit(0).withColumn("confidence", F.lit(0.0))


def unfenced(text: str) -> str:
    """An answer without the fence and the words around its JSON."""
    found = re.search(r"```(?:json)?\s*(.*?)```", text, re.S)
    text = found.group(1) if found else text
    begin, end = text.find("{"), text.rfind("}")
    return text[begin : end + 1] if 0 <= begin < end else text


@dataclass
class Answer:
    confidence: float
    calls: int
    failures: int
    seconds: float
    characters: int


def asked(models: list[Callable[[str], str]], question: str, row: dict, tries: int = 2) -> Answer:
    """The confidence that a question holds of a row: the first of the models to answer with JSON decides; 0 if none does."""
    prompt = f'{question}\nAnswer with JSON alone: {{"confidence": a number from 0 to 1}}.\n{json.dumps(row, ensure_ascii=False, default=str)}'
    begin, failures, characters, calls = time.monotonic(), 0, 0, 0
    for model in models:
        for _ in range(tries):
            calls += 1
            characters += len(prompt)
            try:
                text = model(prompt)
                characters += len(text)
                value = float(json.loads(unfenced(text))["confidence"])
                return Answer(min(1.0, max(0.0, value)), calls, failures, time.monotonic() - begin, characters)
            except (ValueError, KeyError, TypeError, OSError):
                failures += 1
    return Answer(0.0, calls, failures, time.monotonic() - begin, characters)


@dataclass
class PromptProvider:
    """Asks models (functions from prompt to text that tasks can run), one after the other as a fallback."""

    models: list[Callable[[str], str]]

    def available(self) -> bool:
        return bool(self.models)

    def answers(self, kind: str, candidates: DataFrame) -> DataFrame:
        """The candidates with confidence, calls, failures, seconds and characters of each."""
        more = [("confidence", "double"), ("calls", "long"), ("failures", "long"), ("seconds", "double"), ("characters", "long")]
        models, question, names = self.models, QUESTIONS[kind], candidates.columns

        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in it:
                found = [asked(models, question, r) for r in batch.to_dict("records")]
                yield batch.assign(**{c: [getattr(a, c) for a in found] for c, _ in more})[[*names, *(c for c, _ in more)]]

        schema = StructType(list(candidates.schema.fields))
        for c, t in more:
            schema = schema.add(c, t)
        return candidates.mapInPandas(run, schema)

    def ask(self, kind: str, candidates: DataFrame) -> DataFrame:
        return self.answers(kind, candidates).drop("calls", "failures", "seconds", "characters")

    def usage(self, kind: str, candidates: DataFrame) -> DataFrame:
        """Calls, failures, seconds and characters in all."""
        return self.answers(kind, candidates).agg(*[F.sum(c).alias(c) for c in ("calls", "failures", "seconds", "characters")])
