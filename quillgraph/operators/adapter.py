"""Language-model calls as a batch step: any callable from prompt to reply text, retried by rule, resumable."""

from __future__ import annotations

import json
import os
import random
import time
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.replies import validated
from quillgraph.functions.text import INTENTS

Client = Callable[[str, str, int], str]


@dataclass(frozen=True)
class Policy:
    """Attempts, longest pause in seconds, and which failures are tried again."""

    attempts: int = 5
    longest: float = 60.0
    again: tuple[str, ...] = ("api_error",)
    sleep: bool = True

    def pause(self, attempt: int) -> float:
        return min(self.longest, 2.0**attempt) + random.random()


GENERATE, JUDGE = Policy(again=("api_error", "validation_error")), Policy(again=("api_error", "json_parse_error"))


def offline(system: str, prompt: str, budget: int) -> str:
    """A reply made from the prompt alone, for tests and dry runs: the same prompt, the same reply."""
    n = next((int(x.rsplit(":", 1)[1]) for x in prompt.split("\n") if x.startswith("Required citation count:")), None)
    mark = zlib.crc32(prompt.encode("utf-8", "replace"))
    reply = {"motivation": INTENTS[mark % 3], "confidence": ("high", "medium", "low")[mark // 3 % 3]}
    if n is not None:
        reply |= {"recommended_papers": [{"title": f"Work {mark % 9973}-{i}", "authors": "A, B", "year": 2000 + mark % 25, "venue": "V", "doi": None} for i in range(n)], "citation_sentence": f"As shown before [{mark % 97}]."}
    return json.dumps(reply)


def keys(path: str | None, many: str, one: str, spare: str | None = None) -> list[str]:
    """Keys from a JSON file's list, else a comma-separated variable, else a single one, else the spare one."""
    if path and os.path.exists(path):
        with open(path) as f:
            got = json.load(f)
        found = [k for k in (got.get(many, []) if isinstance(got, dict) else got) if k]
        if found:
            return found
    for name in (many, one, spare):
        found = [k.strip() for k in os.environ.get(name or "", "").split(",") if k.strip()]
        if found:
            return found
    return []


def _problem(reply: str, required: int | None) -> str | None:
    """A first look at a reply; the columns of validated() say the same in full."""
    a, b = reply.find("{"), reply.rfind("}")
    try:
        got = json.loads(reply[a : b + 1]) if a >= 0 else None
    except ValueError:
        got = None
    if not isinstance(got, dict):
        return "json_parse_error"
    works = got.get("recommended_papers")
    if required is not None and isinstance(works, list) and len(works) != required:
        return "validation_error"
    return None


def ask(prompts: DataFrame, clients: Sequence[Client], system: str, policy: Policy, budget: str = "budget", turn: str = "context_index", required: str | None = None) -> DataFrame:
    """prompts with reply, error and attempts; the clients take turns by the column `turn` and by attempt."""
    names = prompts.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            out = []
            for i, (prompt, size, k) in enumerate(zip(f["prompt"], f[budget], f[turn], strict=True)):
                want = int(f[required].iloc[i]) if required else None
                text, error, tries = "", None, 0
                for attempt in range(policy.attempts):
                    tries += 1
                    said = prompt if error != "validation_error" else f"{prompt}\nFix from prior attempt: wrong number of works"
                    try:
                        text = clients[(int(k) + attempt) % len(clients)](system, said, int(size))
                        error = _problem(text, want)
                    except Exception:  # whatever a client raises is a failed call
                        error = "api_error"
                    if error not in policy.again:
                        break
                    if policy.sleep and attempt + 1 < policy.attempts:
                        time.sleep(policy.pause(attempt))
                out.append((text, error, tries))
            f = f.copy()
            f["reply"], f["error"], f["attempts"] = zip(*out, strict=True) if out else ([], [], [])
            yield f

    schema = ", ".join(f"`{c}` {t}" for c, t in prompts.dtypes) + ", reply string, error string, attempts int"
    return prompts.select(*names).mapInPandas(run, schema)


def generated(prompts: DataFrame, clients: Sequence[Client] = (offline,), system: str = "", policy: Policy = GENERATE) -> DataFrame:
    """Slots with the repaired reply; an error of the call itself comes before one of its content."""
    at = ask(prompts, clients, system, policy, required="num_citations_required")
    v = validated(F.col("reply"), F.col("num_citations_required"))
    return at.withColumn("result", v).withColumn("error", F.when(F.col("error") == "api_error", F.col("error")).otherwise(F.col("result.error")))


def judged(prompts: DataFrame, clients: Sequence[Client] = (offline,), system: str = "", policy: Policy = JUDGE, sentence: str | None = None, failed: str | None = None) -> DataFrame:
    """Slots with intent and confidence.

    `sentence` names the column with the filled sentence, `failed` that with the error of the response: slots with an
    error there or without a sentence are errors without a call.
    """
    from quillgraph.functions.replies import json_object

    before = F.lit(None).cast("string")
    if sentence:
        before = F.when(F.coalesce(F.col(sentence), F.lit("")) == "", "missing_filled_sentence")
    if failed:
        before = F.when(F.col(failed).isNotNull(), "no_script03_response").otherwise(before)
    at = ask(prompts.where(before.isNull()), clients, system, policy)
    if sentence or failed:
        at = at.unionByName(prompts.where(before.isNotNull()).select(*prompts.columns, F.lit("").alias("reply"), before.alias("error"), F.lit(0).alias("attempts")))
    v = json_object(F.col("reply"))
    return at.withColumn("intent", F.try_variant_get(v, "$.motivation", "string")).withColumn("confidence", F.try_variant_get(v, "$.confidence", "string"))


def repaired(results: DataFrame, again: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """results with the errored rows run again."""
    bad = results.where(F.col("error").isNotNull())
    return results.where(F.col("error").isNull()).unionByName(again(bad).select(*results.columns))
