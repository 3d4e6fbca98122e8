"""Model requests and replies: what is sent, how replies are read and put back."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TYPES = ("speech", "thought", "sfx", "narration", "sign")
ITEM = "array<struct<i:string,tl:string,translation:string,text:string,t:string>>"
BLANK = "—"
WHITE = r"^[\s]+|[\s]+$"


def is_noise(text: Column) -> Column:
    size = F.length(F.trim(text))
    return (size < 2) | (size > 150)


def send_set(items: DataFrame, key: str = "reply_id") -> DataFrame:
    """Rows that aren't noise; all rows of a page where every one is. `noise` and `sent` tell which."""
    real = F.count_if(~is_noise(F.col("text"))).over(Window.partitionBy(key))
    return items.withColumn("noise", is_noise(F.col("text"))).withColumn("sent", ~F.col("noise") | (real == 0))


def clean_type(t: Column) -> Column:
    return F.when(t.isin(*TYPES), t).otherwise("speech")


def parse_items(replies: DataFrame, body: str = "body", key: str = "translations") -> DataFrame:
    """replies with items (array, null where none was found), strategy (1-4) and reason.

    Fences go first. Candidates in turn: the whole text (a list, or an object with the key); from the
    last key its first [ to the last ]; from the last { before that key; from the first [ to the
    last ]. Each must parse as JSON."""
    clean = F.trim(F.replace(F.regexp_replace(body, r"```(json)?\n?", ""), F.lit("```"), F.lit("")))
    r = replies.withColumn("_c", F.coalesce(clean, F.lit("")))
    last = lambda c, what: F.length(c) - F.length(F.substring_index(c, what, -1)) - len(what) + 1  # noqa: E731  1-based, of a part that is there
    has = F.contains(F.col("_c"), F.lit(f'"{key}"'))
    r = r.withColumn("_k", F.when(has, last(F.col("_c"), f'"{key}"')))
    r = r.withColumn("_open", F.when(F.col("_k").isNotNull(), F.locate("[", F.col("_c"))).cast("int")).withColumn("_tail", F.expr("substring(_c, _k)")).withColumn("_open", F.expr("_k + instr(_tail, '[') - 1"))
    r = r.withColumn("_end", F.when(F.contains(F.col("_c"), F.lit("]")), last(F.col("_c"), "]"))).withColumn("_head", F.expr("substring(_c, 1, _k)"))
    r = r.withColumn("_brace", F.when(F.contains(F.col("_head"), F.lit("{")), last(F.col("_head"), "{")))
    listed = lambda s: F.when(F.startswith(F.ltrim(s), F.lit("[")), F.from_json(s, ITEM))
    keyed = lambda s: F.when(F.startswith(F.ltrim(s), F.lit("{")), F.from_json(s, f"struct<{key}:{ITEM}>")[key])
    whole = F.coalesce(listed(F.col("_c")), keyed(F.col("_c")))
    second = F.when((F.instr("_tail", "[") > 0) & (F.col("_end") > F.col("_open")), listed(F.expr("substring(_c, _open, _end - _open + 1)")))
    third = F.when(F.col("_brace") > 0, keyed(F.expr("substring(_c, _brace)")))
    any_list = listed(F.regexp_extract("_c", r"(?s)\[.*\]", 0))
    found = r.select(*replies.columns, "_c", whole.alias("_1"), second.alias("_2"), third.alias("_3"), any_list.alias("_4"))
    strategy = F.when(F.col("_1").isNotNull(), 1).when(F.col("_2").isNotNull(), 2).when(F.col("_3").isNotNull(), 3).when(F.col("_4").isNotNull(), 4)
    reason = F.when(F.col("_c") == "", "empty").when(strategy.isNull(), "no JSON list")
    return found.select(*replies.columns, F.coalesce("_1", "_2", "_3", "_4").alias("items"), strategy.alias("strategy"), reason.alias("reason"))


def quarantine(parsed: DataFrame) -> DataFrame:
    return parsed.where("items IS NULL")


def apply_replies(sent: DataFrame, parsed: DataFrame, key: str = "reply_id") -> DataFrame:
    """sent(key, i, text) with tl and t. An item counts where its index is all digits and that of a row; the
    last of several wins; rows without one keep the blank, as sfx where they are noise."""
    items = parsed.select(key, F.posexplode("items").alias("pos", "item")).where(F.trim("item.i").rlike(r"^\d+$"))
    told = items.groupBy(key, F.regexp_replace(F.trim("item.i"), "^0+(?=.)", "").alias("_i")).agg(F.max_by("item", "pos").alias("item"))
    out = sent.withColumn("_i", F.col("i").cast("string")).join(told, [key, "_i"], "left")
    tl = F.coalesce("item.tl", "item.translation", "item.text", F.lit(BLANK))
    kept = F.col("item").isNull()
    return out.select(*sent.columns, F.when(kept, BLANK).otherwise(tl).alias("tl"), F.when(kept, F.when(is_noise(F.col("text")), "sfx").otherwise("speech")).otherwise(clean_type(F.col("item.t"))).alias("t"))


def apply_positional(sent: DataFrame, texts: DataFrame, key: str = "reply_id") -> DataFrame:
    """The k-th text of texts(key, texts) to the k-th sent row; a short reply leaves blanks."""
    placed = sent.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy("i")) - 1)
    told = texts.select(key, F.posexplode("texts").alias("pos", "tl"))
    return placed.join(told, [key, "pos"], "left").select(*sent.columns, F.coalesce("tl", F.lit(BLANK)).alias("tl"))


def flow_diff(regions: DataFrame, issues: DataFrame, key: str = "reply_id") -> DataFrame:
    """issues(key, n, fix, why) against the translated regions in (cy, cx) order, of which there must be
    two at least: a valid number, a text that isn't blank and does change something."""
    real = regions.where(F.trim(F.coalesce("tl", F.lit(""))).isin("", BLANK) == False)  # noqa: E712
    w = Window.partitionBy(key)
    placed = real.withColumn("n", F.row_number().over(w.orderBy("cy", "cx", "i")) - 1).withColumn("all", F.count("*").over(w)).where("all >= 2")
    fix = F.trim("fix")
    return placed.join(issues, [key, "n"]).where((fix != "") & (fix != F.trim("tl"))).select(key, "i", F.col("tl").alias("before"), fix.alias("after"), "why")


def build_requests(items: DataFrame, instruction: str, hints: DataFrame, glossary: DataFrame, key: str = "reply_id") -> DataFrame:
    """One request a page: instruction with the language's hint, glossary block, items as JSON, their number.
    hints(lang, hint); glossary(key, block)."""
    sent = send_set(items, key).where("sent")
    row = F.struct("i", "text", F.bround("cx", 1).alias("cx"), F.bround("cy", 1).alias("cy"))
    pages = sent.groupBy(key, "lang").agg(F.to_json(F.array_sort(F.collect_list(row))).alias("items"), F.count("*").alias("expected"))
    hinted = pages.join(F.broadcast(hints), "lang", "left").join(glossary, key, "left")
    return hinted.select(key, F.concat(F.lit(instruction), F.coalesce(F.concat(F.lit("\n"), "hint"), F.lit(""))).alias("instruction"), F.coalesce("block", F.lit("")).alias("glossary"), "items", "expected")


def glossary_block(terms: DataFrame, key: str = "series_name") -> DataFrame:
    """(key, block): `src → tl (note)` lines of terms with both sides, in order."""
    line = F.concat(F.trim("src"), F.lit(" → "), F.trim("tl"), F.when(F.trim(F.coalesce("note", F.lit(""))) != "", F.concat(F.lit(" ("), F.trim("note"), F.lit(")"))).otherwise(""))
    full = (F.trim(F.coalesce("src", F.lit(""))) != "") & (F.trim(F.coalesce("tl", F.lit(""))) != "")
    lines = F.array_sort(F.collect_list(F.when(full, F.struct("pos", line.alias("line")))))
    return terms.groupBy(key).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("block"))


def reply_text(raw: DataFrame, body: str = "body") -> DataFrame:
    """raw with answer, prompt_tokens and completion_tokens of either reply shape: candidates with parts (the
    first part with text that is no thought, else the first), or choices with a message."""
    part = "array<struct<text:string,thought:boolean>>"
    shape = f"struct<candidates:array<struct<content:struct<parts:{part}>>>,usageMetadata:struct<promptTokenCount:bigint,candidatesTokenCount:bigint>,choices:array<struct<message:struct<content:string>>>,usage:struct<prompt_tokens:bigint,completion_tokens:bigint>>"
    r = raw.withColumn("r", F.from_json(body, shape))
    parts = F.get(F.col("r.candidates"), F.lit(0))["content"]["parts"]
    plain = F.get(F.filter(parts, lambda p: ~F.coalesce(p["thought"], F.lit(False)) & (F.trim(F.coalesce(p["text"], F.lit(""))) != "")), F.lit(0))["text"]
    answer = F.coalesce(plain, F.get(parts, F.lit(0))["text"], F.get(F.col("r.choices"), F.lit(0))["message"]["content"])
    return r.select(*raw.columns, answer.alias("answer"), F.coalesce("r.usageMetadata.promptTokenCount", "r.usage.prompt_tokens").alias("prompt_tokens"), F.coalesce("r.usageMetadata.candidatesTokenCount", "r.usage.completion_tokens").alias("completion_tokens"))


def _rescued(text: str | None, key: str) -> str:
    """What the brace round the last key opens, if it parses up to the end and holds the key; else the first
    stretch that looks like an object with a list under the key; else nothing."""
    text = text or ""
    depth, at = 0, text.rfind(f'"{key}"')
    for brace in reversed([m.start() for m in re.finditer(r"[{}]", text[: max(at, 0)])]):
        depth += 1 if text[brace] == "}" else -1
        if depth < 0:
            try:
                found = json.loads(text[brace:])
            except ValueError:
                break
            if isinstance(found, dict) and key in found:
                return text[brace:]
            break
    loose = re.search(rf'\{{[^{{}}]*?"{re.escape(key)}"\s*:\s*\[.*?\]\s*\}}', text, re.DOTALL)
    return loose.group(0) if loose else ""


def rescue_json(replies: DataFrame, answer: str = "answer", text: str = "reasoning", key: str = "translations") -> DataFrame:
    """replies with `rescued`, JSON found in a text beside a blank answer, null beside others: only rows with
    a blank answer go through Python, in Arrow batches."""
    blank = F.coalesce(F.trim(answer), F.lit("")) == ""

    def rescue(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.assign(rescued=[_rescued(t, key) for t in rows[text]])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in replies.schema)
    told = replies.where(blank).mapInPandas(rescue, f"{kinds}, rescued string")
    return told.union(replies.where(~blank).withColumn("rescued", F.lit(None).cast("string")))


def translate_pages(requests: DataFrame, call: Callable[[str, str], str], delays: tuple[float, ...] = (1.0, 4.0), rate_error: type[Exception] = ConnectionError) -> DataFrame:
    """requests with body, status and reason: the user's call(instruction, items), tried again after each
    delay on a rate error; any other error ends the row, not the job."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for instruction, items in zip(rows["instruction"], rows["items"], strict=True):
                for pause in (*delays, None):
                    try:
                        out.append((call(instruction, items), "ok", None))
                        break
                    except rate_error as error:
                        if pause is None:
                            out.append((None, "error", str(error)))
                        else:
                            time.sleep(pause)
                    except Exception as error:  # noqa: BLE001  the row's own outcome
                        out.append((None, "error", f"{type(error).__name__}: {error}"))
                        break
            yield rows.assign(body=[o[0] for o in out], status=[o[1] for o in out], reason=[o[2] for o in out])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema)
    return requests.mapInPandas(work, f"{kinds}, body string, status string, reason string")
