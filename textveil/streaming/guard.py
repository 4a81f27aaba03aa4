"""The message guard as streams: detection, policy and masking on what comes in, restoring in the answers that come in time."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.detectors import ALL, detect
from ..operators.mask import PLACEHOLDER, apply_policy, restored


def guard(messages: DataFrame, policy: dict[str, str], path: str, checkpoint: str, detectors=ALL, key: str = "request_id", role: str | None = "role", ts: str | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Writes passed, rejected and vault below ``path``, batch by batch. A batch that is done again overwrites its own folder.

    With ``ts``, the time of a message, also requests (key, values, ts), a row for each message that passes, for restore_requests().
    """

    def batch(df: DataFrame, number: int) -> None:
        found = detect(df, key=key, detectors=detectors).persist()
        passed, rejected, vault = apply_policy(found, policy, key=key, role=role, values="__values" if ts else None)
        parts = {"passed": passed.drop("__values"), "rejected": rejected, "vault": vault}
        if ts:
            parts["requests"] = passed.select(key, F.col("__values").alias("values"), F.col(ts).alias("ts"))
        for name, part in parts.items():
            part.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        found.unpersist()

    return messages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def restore_requests(answers: DataFrame, requests: DataFrame, within: int = 60, late: int = 60, key: str = "request_id") -> DataFrame:
    """One row (key, text, ts, restored, in_time) for each answer (key, text, ts) to what guard() wrote as requests (key, values, ts).

    State is kept by request. An answer is in time up to ``within`` seconds after a message of its request; it gets the values of all such
    messages, those of later ones before those of earlier ones, so a request that is sent again neither doubles its answer nor lets the
    first one's time run out. An answer to messages whose time is over stays masked. One that comes before its request waits, until the
    watermark is ``late`` seconds past it, and then stays masked; so long the values of a request are kept beyond their time.
    """
    mine = answers.withWatermark("ts", f"{late} seconds").select(key, "ts", "text", F.lit(None).cast("string").alias("values"))
    asked = requests.withWatermark("ts", f"{late} seconds").select(key, "ts", F.lit(None).cast("string").alias("text"), F.to_json("values").alias("values"))
    kind = answers.schema[key].dataType.simpleString()

    def run(at: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        told, waiting = map(json.loads, state.get) if state.exists else ([], [])
        out: list[tuple] = []
        if state.hasTimedOut:
            out = [(text, t, text, False) for t, text in waiting]
            state.remove()
        else:
            for b in batches:
                for t, text, values in zip(b["ts"].dt.as_unit("us").astype("int64"), b["text"], b["values"], strict=True):
                    if isinstance(values, str):
                        told.append([int(t), json.loads(values)])
                    else:
                        waiting.append([int(t), text])
            still = []
            for t, text in waiting:
                near = [v for asked_at, v in sorted(told, key=lambda x: x[0]) if 0 <= t - asked_at <= within * 1_000_000]
                known = {k: v for values in near for k, v in values.items()}
                if near:
                    out.append((text, t, re.sub(PLACEHOLDER, lambda m: known.get(m[0], m[0]), text or "") if text is not None else None, True))  # noqa: B023
                elif told and t > max(x[0] for x in told):
                    out.append((text, t, text, False))
                else:
                    still.append([t, text])
            state.update((json.dumps(told), json.dumps(still)))
            last = max([x[0] + within * 1_000_000 for x in told] + [t for t, _ in still]) // 1000 + late * 1000
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs() + 1))
        if out:
            text, t, back, ok = zip(*out, strict=True)
            yield pd.DataFrame({key: at[0], "text": text, "ts": pd.to_datetime(list(t), unit="us"), "restored": back, "in_time": ok})

    both = mine.unionByName(asked)
    return both.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, text string, ts timestamp, restored string, in_time boolean", "told string, waiting string", "append", "EventTimeTimeout")


def restore_stream(answers: DataFrame, vault: DataFrame, within: str = "60 seconds", late: str = "60 seconds", key: str = "request_id") -> DataFrame:
    """Answers (key, text, ts) with ``restored``: a left join with the vault's maps (key, values, ts) of requests at most ``within`` before.

    Both sides have watermarks, so state goes when no match can come; an answer that comes later stays masked.
    """
    a = answers.withWatermark("ts", late).alias("a")
    v = vault.select(F.col(key).alias("__key"), F.col("values").alias("__values"), F.col("ts").alias("__ts")).withWatermark("__ts", late).alias("v")
    on = F.expr(f"a.{key} = v.__key AND a.ts >= v.__ts AND a.ts <= v.__ts + INTERVAL {within}")
    out = a.join(v, on, "leftOuter")
    return out.withColumn("restored", F.when(F.col("__values").isNull(), F.col("text")).otherwise(restored(F.col("text"), F.col("__values")))).drop("__key", "__values", "__ts")
