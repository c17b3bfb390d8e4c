"""Text lines for readers: cues, commands, answers."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemospark.functions.text import column, iso_day


def belief_line(kind: str, text: str) -> Column:
    """'- [kind · 0.87 · origin] text' of a node or an edge; halves of a hundredth are rounded up."""
    return F.concat(F.lit("- ["), kind, F.lit(" · "), F.format_string("%.2f", F.round(F.col("confidence") + 1e-9, 2)), F.lit(" · "), "origin", F.lit("] "), F.coalesce(text, F.lit("")))


def record_line() -> Column:
    """'- [episode · 2024-01-31 · verbatim] text' of a record; the day is UTC."""
    return F.concat(F.lit("- [episode · "), iso_day("created_at"), F.lit(" · "), "fidelity", F.lit("] "), F.coalesce("text", F.lit("")))


def memory_command(raw: Column | str) -> Column:
    """STRUCT<kind, argument> of a typed command: show, suggest, stats, search <words>, forget <label>, or usage."""
    flat = F.trim(F.regexp_replace(column(raw), r"\s+", " "))
    head = F.lower(F.split_part(flat, F.lit(" "), F.lit(1)))
    rest = F.regexp_replace(flat, r"^\S+\s*", "")
    kind = F.when(flat == "", "show").when(head.isin("suggest", "stats"), head).when(head.isin("search", "forget") & (rest != ""), head).otherwise("usage")
    return F.struct(kind.alias("kind"), F.when(kind.isin("search", "forget"), rest).alias("argument"))


#: Commands that change files, runners of tests, shells.
CHANGING = "rm mv cp mkdir touch tee set-content add-content out-file new-item remove-item move-item copy-item rename-item".split()
RUNNERS = "pytest vitest jest mocha ctest".split()
MANAGED = "npm pnpm npx yarn bun cargo go dotnet mvn".split()
EDITING_TOOLS = "write edit apply_patch delete remove move rename mkdir".split()


def call_role(tool: Column | str, command: Column | str) -> Column:
    """'action', 'check' or 'unknown' of a tool call: editing tools and changing commands act, test runners check.

    Quoted text doesn't count as a command; output redirected to a file is a change; printing a claim isn't a check.
    """
    t, c = F.coalesce(column(tool), F.lit("")), F.coalesce(column(command), F.lit(""))
    bare = F.lower(F.regexp_replace(F.regexp_replace(c, r"\"[^\"]*\"|'[^']*'", " "), r"(?m)#.*$", " "))
    start = r"(?:^|[;&|\n])\s*"
    changing = bare.rlike(start + r"(?:sudo\s+)?(?:" + "|".join(CHANGING) + r")\b") | bare.rlike(r"(?:^|\s)\d*>>?\s") | bare.rlike(r"\bgit\s+(?:apply|reset|checkout|commit)\b|\b(?:npm|pnpm)\s+install\b")
    checking = bare.rlike(start + r"(?:python[\d.]*\s+-m\s+(?:pytest|unittest)|(?:" + "|".join(RUNNERS) + r"))\b") | bare.rlike(start + r"(?:" + "|".join(MANAGED) + r")\s+(?:(?:exec|run)\s+)?(?:test|check|verify|" + "|".join(RUNNERS) + r")\b")
    shell = t.isin("bash", "pwsh")
    return F.when(~shell & t.isin(*EDITING_TOOLS), "action").when(~shell, "unknown").when(changing, "action").when(checking, "check").otherwise("unknown")


def call_execution(text: Column | str) -> Column:
    """'completed', 'failed' or 'incomplete' of a shell result by its closing status line."""
    t = F.coalesce(column(text), F.lit(""))
    code = F.regexp_extract(t, r"(?i)\[(?:exit code:|command finished with exit code|shell exited: code)\s*(-?\d+)\]\s*$", 1)
    running = t.rlike(r"(?i)\[(?:timed out after |stopped:|still running after |status: (?:running|stopping))|^started background job\b")
    killed = t.rlike(r"(?i)\[(?:shell )?killed by signal:")
    return F.when(running, "incomplete").when(killed | ((code != "") & (code != "0")), "failed").otherwise("completed")


@F.pandas_udf(T.StringType())
def first_json_object(replies: pd.Series) -> pd.Series:
    """The first balanced JSON object in each reply, inside a code fence if there is one; '{}' where none parses."""

    def find(reply: str | None) -> str:
        text = reply or ""
        if "```" in text:
            inner = text.split("```", 2)[1]
            text = inner.removeprefix("json").strip()
        decoder, at = json.JSONDecoder(), text.find("{")
        if at < 0:
            return "{}"
        try:
            return json.dumps(decoder.raw_decode(text, at)[0], ensure_ascii=False, sort_keys=True)
        except ValueError:
            return "{}"

    return replies.map(find)
