"""Completions and embeddings from a provider, called from tasks within a rate; providers are injected callables."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..streaming.grants import Client, shared

#: A prompt and a model's name give the answer and its (cost, tokens in, tokens out).
Complete = Callable[[str, str], tuple[str, tuple[float, int, int]]]
Embed = Callable[[Sequence[str]], Sequence[Sequence[float]] | None]

#: The fields of the answer that a provider is asked for, as a type.
ANSWER = "array<struct<name:string,description:string,recipeIngredients:array<string>,recipeInstructions:array<string>,recipeYield:string,image:string,keywords:array<string>>>"
REQUIRED = ("name", "recipeIngredients", "recipeInstructions")

ATTEMPTS, FIRST_WAIT_S = 5, 2.0
#: Texts embedded in one call.
BATCH = 6
#: The model of each provider and way of extraction.
MODELS = {("GEMINI", "file"): "gemini-2.5-flash-lite", ("GEMINI", "block"): "gemini-2.5-flash"}


def model_for(provider: Column, method: Column, override: Column | None = None) -> Column:
    chosen = F.lit(None).cast("string")
    for (p, m), name in MODELS.items():
        chosen = F.when((provider == p) & (method == m), name).otherwise(chosen)
    return chosen if override is None else F.coalesce(F.nullif(override, F.lit("")), chosen)


def retried(call: Callable, *args, attempts: int = ATTEMPTS, first_wait: float = FIRST_WAIT_S, sleep=time.sleep):
    """call(*args), tried again after 2, 4, 8 ... seconds; the last failure is raised."""
    for i in range(attempts):
        try:
            return call(*args)
        except Exception:
            if i == attempts - 1:
                raise
            sleep(first_wait * 2**i)


def completed(prompts: DataFrame, complete: Complete, rate_per_minute: float = 256, tasks: int = 16, first_wait: float = FIRST_WAIT_S, at_once: int = 16, grants: Client | None = None) -> DataFrame:
    """prompts (key, prompt, model) with (response, cost_usd, input_tokens, output_tokens, error). `tasks` tasks call the
    provider, at most at_once of them at a time. The driver grants their calls, second tries included, so that rate and
    slots hold for all of them together, and for other jobs with the same rate and slots, or the same grants. A prompt whose
    attempts all fail has its error, and the others go on."""
    names = ["key", "response", "cost_usd", "input_tokens", "output_tokens", "error"]
    types = (pa.string(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.string())
    client = grants or shared(prompts.sparkSession, rate_per_minute, at_once)

    def run(batches):
        with client.connected() as granted:

            def call(prompt, model):
                with granted():
                    return complete(prompt, model)

            for batch in batches:
                rows = []
                for key, prompt, model in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    try:
                        answer, (cost, tokens_in, tokens_out) = retried(call, prompt, model, first_wait=first_wait)
                        rows.append((key, answer, cost, tokens_in, tokens_out, None))
                    except Exception as e:
                        rows.append((key, None, 0.0, 0, 0, str(e)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return prompts.select(F.col("key").cast("string").alias("key"), "prompt", "model").repartition(tasks).mapInArrow(run, "key string, response string, cost_usd double, input_tokens int, output_tokens int, error string")


def answered(response: Column, kind: str | T.DataType = ANSWER, required: Sequence[str] = REQUIRED) -> Column:
    """The recipes of an answer in JSON that have all required fields; null where the text is no such list."""
    return F.filter(F.from_json(response, kind), lambda r: reduce(and_, (r[f].isNotNull() for f in required), F.lit(True)))


def schema_of(spark: SparkSession, path: str) -> tuple[T.DataType, list[str]]:
    """(type, required fields) of a JSON schema's file, for answered(). Arrays, objects and simple types are known, a type
    that may also be null counts as the other; what has no known type is read as text."""
    schema = json.loads(spark.read.text(path, wholetext=True).first()[0])
    elements = schema.get("items", {}) if schema.get("type") == "array" else schema
    return _type_of(schema), list(elements.get("required", ()))


def _type_of(schema: dict) -> T.DataType:
    kinds = schema.get("type", "string")
    kind = next((k for k in ([kinds] if isinstance(kinds, str) else kinds) if k != "null"), "string")
    if kind == "array":
        return T.ArrayType(_type_of(schema.get("items", {})))
    if kind == "object" and schema.get("properties"):
        return T.StructType([T.StructField(name, _type_of(x)) for name, x in schema["properties"].items()])
    return {"number": T.DoubleType(), "integer": T.LongType(), "boolean": T.BooleanType()}.get(kind, T.StringType())


def embedded(texts: DataFrame, embed: Embed) -> DataFrame:
    """(recipe_id, embedding) of texts (recipe_id, text), BATCH texts a call; a call that gives nothing leaves its texts
    without a vector, one that gives another number of vectors than texts is an error."""

    def run(batches):
        for batch in batches:
            ids, words = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo in range(0, len(ids), BATCH):
                vectors = embed(words[lo : lo + BATCH])
                if vectors:
                    pairs = list(zip(ids[lo : lo + BATCH], vectors, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([[float(x) for x in p[1]] for p in pairs], pa.list_(pa.float32()))], ["recipe_id", "embedding"])

    return texts.select(F.col("recipe_id").cast("long").alias("recipe_id"), "text").mapInArrow(run, "recipe_id long, embedding array<float>")


def hashed_words(texts: Sequence[str], width: int = 64) -> list[list[float]]:
    """A stand-in provider without a network: counts of hashed words."""
    import zlib

    out = []
    for text in texts:
        v = [0.0] * width
        for word in (text or "").lower().split():
            v[zlib.crc32(word.encode()) % width] += 1.0
        out.append(v)
    return out
