"""Optional language-model step: prompts, answers and their validation. The client is injected; without one nothing is asked."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def route(label_class: Column, candidates: Column) -> Column:
    return F.when(label_class.isin("EMPTY", "CRYPTIC"), "cryptic").when(candidates > 1, "ambiguous").otherwise("generic")


def invoice_table(invoices: Column, most: int = 20) -> Column:
    """Markdown rows of the first invoices, and how many more there are. invoices: array<struct<reference, a>>."""
    rows = F.array_join(F.transform(F.slice(invoices, 1, most), lambda i: F.concat(F.lit("| "), i["reference"], F.lit(" | "), (i["a"] / 100).cast("string"), F.lit(" |"))), "\n")
    more = F.size(invoices) - most
    return F.when(more > 0, F.concat(rows, F.lit("\n... and "), more.cast("string"), F.lit(" more"))).otherwise(rows)


def extract_json(answer: str) -> dict | None:
    """The answer itself, a fenced block, or the first balanced braces outside strings."""
    text = answer or ""
    tries = [text]
    if "```" in text:
        tries += [b.removeprefix("json").strip() for b in text.split("```")[1::2]]
    depth, start, quoted, escaped = 0, -1, False, False
    for i, c in enumerate(text):
        if escaped:
            escaped = False
        elif c == "\\":
            escaped = True
        elif c == '"':
            quoted = not quoted
        elif not quoted and c == "{":
            start = i if depth == 0 else start
            depth += 1
        elif not quoted and c == "}" and depth:
            depth -= 1
            if depth == 0:
                tries.append(text[start : i + 1])
    for t in tries:
        try:
            found = json.loads(t)
        except ValueError:
            continue
        if isinstance(found, dict):
            return found
    return None


def ask(prompts: DataFrame, client: Callable[[str], str] | None, retries: int = 2) -> DataFrame:
    """prompt_hash, answer: each distinct prompt once. prompts: prompt."""
    once = prompts.select(F.sha2("prompt", 256).alias("prompt_hash"), "prompt").dropDuplicates(["prompt_hash"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            answers = []
            for p in pdf["prompt"]:
                answer = None
                for _ in range(retries + 1):
                    try:
                        answer = client(p) if client else None
                        break
                    except OSError:
                        continue
                answers.append(answer)
            yield pd.DataFrame({"prompt_hash": pdf["prompt_hash"], "answer": answers})

    return once.mapInPandas(run, "prompt_hash string, answer string")


def validate(answers: DataFrame) -> DataFrame:
    """answers with errors array<string>. Columns: x (cents), refs and allocated (parallel arrays), amounts map<string,long> of open invoices, confidence, reasoning."""
    unknown = F.size(F.array_except("refs", F.map_keys("amounts"))) > 0
    wrong = F.exists(F.arrays_zip("refs", "allocated"), lambda p: (p["allocated"] <= 0) | (p["allocated"] * 10 > F.coalesce(F.element_at(F.col("amounts"), p["refs"]), F.lit(0)) * 11))
    over = F.aggregate("allocated", F.lit(0).cast("long"), lambda s, v: s + v) * 100 > F.col("x") * 105
    checks = (("UNKNOWN_REFERENCE", unknown), ("BAD_ALLOCATION", wrong), ("OVER_ALLOCATED", over), ("TOO_SURE", F.col("confidence") > 0.99), ("NO_REASONING", F.trim(F.coalesce("reasoning", F.lit(""))) == ""))
    return answers.withColumn("errors", F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in checks])))


def usage(calls: DataFrame, prices: dict[str, tuple[float, float]]) -> DataFrame:
    """Tokens, calls and cost by model. prices: per 1000 tokens in and out, first name that the model contains."""
    price = lambda k: F.coalesce(*[F.when(F.contains("model", F.lit(m)), F.lit(v[k])) for m, v in prices.items()], F.lit(0.0))
    cost = F.col("tokens_in") / 1000 * price(0) + F.col("tokens_out") / 1000 * price(1)
    return calls.groupBy("model").agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.round(F.sum(cost), 6).alias("cost"))
