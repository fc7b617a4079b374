"""Job prompts from templates, facts of any depth as text, and the forms of address read back out of prompts."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialoom.functions.sampling import draw

#: Fixed value: how a prompt words what the citizen says for both sides.
ADDRESS = r'tự xưng "([\p{L}\p{M}\p{N}_]+)", gọi cán bộ là "([\p{L}\p{M}\p{N}_]+)"'
#: What a citizen may say for himself and for the officer; a parameter.
FORMS = [("em", "anh"), ("em", "chị"), ("cháu", "cô"), ("cháu", "chú"), ("tôi", "anh"), ("tôi", "chị")]
TEMPLATE = (
    'Viết một đoạn hội thoại về {title} (lĩnh vực: {domain}). Công dân: {persona}, tự xưng "{own}", gọi cán bộ là "{other}". '
    "Đúng {num_turns} lượt. Mở đầu: {opener}. Kết thúc: {closing}. Cán bộ {answers}{clarify}.\n{facts}"
)


def filled(template: str, slots: Mapping[str, Column]) -> Column:
    """The template with each {slot} replaced by its column, null as empty; values are never searched for slots again."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.coalesce(slots[x].cast("string"), F.lit("")) if k % 2 else F.lit(x) for k, x in enumerate(parts)])


def with_prompts(jobs: DataFrame, template: str = TEMPLATE, forms: list[tuple[str, str]] = FORMS, seed: str = "42") -> DataFrame:
    """jobs of synth.jobs() with own and other (drawn forms of address), answers (a drawn style) and prompt."""
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in forms])
    pair = F.element_at(pairs, (draw(seed, F.lit("address"), "job_id") % len(forms) + 1).cast("int"))
    rows = jobs.withColumn("own", pair["a"]).withColumn("other", pair["b"])
    rows = rows.withColumn("answers", F.when(draw(seed, F.lit("answers"), "job_id") % 2 == 0, "trả lời ngắn").otherwise("trả lời đủ ý"))
    slots = {c: F.col(c) for c in ("domain", "persona", "own", "other", "num_turns", "opener", "closing", "answers")}
    slots |= {"title": F.col("source_doc_id"), "clarify": F.when(F.col("clarify"), ", có một lần hỏi lại"), "facts": F.array_join(F.transform("facts_used", lambda x: F.concat(F.lit("- "), x)), "\n")}
    return rows.withColumn("prompt", filled(template, slots))


def addresses(jobs: DataFrame, pattern: str = ADDRESS) -> DataFrame:
    """dialogue_id and address (both forms, or null where the prompt has none) of each job(job_id, prompt)."""
    own, other = (F.regexp_extract("prompt", pattern, k) for k in (1, 2))
    found = F.when(F.coalesce(F.col("prompt").rlike(pattern), F.lit(False)), F.concat_ws("|", own, other))
    return jobs.select(F.concat(F.lit("d_"), "job_id").alias("dialogue_id"), found.alias("address"))


def with_address(dialogues: DataFrame, jobs: DataFrame) -> DataFrame:
    """dialogues with the address of the job that asked for them; null where there is none. Spark broadcasts jobs if they are few."""
    return dialogues.join(addresses(jobs), "dialogue_id", "left")


def _flat(value: object) -> str:
    if isinstance(value, dict):
        return "; ".join(f"{k}: {_flat(v)}" for k, v in value.items())
    return "; ".join(map(_flat, value)) if isinstance(value, list) else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


@F.pandas_udf(T.StringType())
def fact_text(value: pd.Series) -> pd.Series:
    """JSON of any depth as one line: items and entries joined by '; ', entries as 'key: value'. Null, or no JSON: as it is."""

    def line(x: str | None) -> str | None:
        try:
            return None if x is None else _flat(json.loads(x))
        except ValueError:
            return x

    return value.map(line, na_action="ignore")
