"""p4: conversations of history_messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mnemospark.llm.conversations import rebuild_conversations, session_report
from mnemospark.runtime import checkpointed, table


def _messages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "history_messages").select("id", "session_id", "role", "at_ms", "text")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return rebuild_conversations(_messages(spark, d)).select("session_id", "turn_no", "message_id")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    messages = _messages(spark, d)
    return session_report(messages, checkpointed(rebuild_conversations(messages)))


def queries() -> dict:
    return {"p4_found": p4_found, "p4_report": p4_report}


_UNSEEN = "[\\s\\x{0000}-\\x{001f}\\x{007f}-\\x{00a0}\\x{00ad}\\x{034f}\\x{061c}\\x{115f}\\x{1160}\\x{17b4}\\x{17b5}\\x{180e}\\x{1680}\\x{2000}-\\x{200f}\\x{2028}-\\x{202f}\\x{205f}-\\x{206f}\\x{2800}\\x{3000}\\x{3164}\\x{fe00}-\\x{fe0f}\\x{feff}\\x{ffa0}]+"
_SQL = f"""
WITH rows_ AS (
  SELECT id, lower(trim(session_id)) AS session, lower(trim(role)) AS r, CASE WHEN at_ms < 100000000000 THEN at_ms * 1000 ELSE at_ms END AS ms, text FROM history_messages),
merged AS (
  SELECT session, CASE WHEN r IN ('user', 'human') THEN 0 WHEN r IN ('assistant', 'ai', 'bot', 'model') THEN 1 END AS speaker,
    CASE WHEN r IN ('user', 'human', 'assistant', 'ai', 'bot', 'model') THEN NULL ELSE r END AS other, ms, text, min(id) AS id
  FROM rows_ WHERE session <> '' AND (r IS NULL OR r NOT IN ('system', 'tool')) GROUP BY ALL),
marked AS (
  SELECT *, coalesce(length(regexp_replace(text, '{_UNSEEN}', '', 'g')) > 0, false) AS seen,
    row_number() OVER (PARTITION BY session ORDER BY ms, speaker, id) - 1 AS turn_no FROM merged),
states AS (
  SELECT session, count(*) AS messages, count(*) FILTER (speaker IS NULL) AS bad_role, count(*) FILTER (ms IS NULL) AS bad_time,
    count(*) FILTER (NOT seen) AS unseen, count(*) FILTER (speaker = 0) AS users, count(*) FILTER (speaker = 1) AS assistants,
    bool_and(coalesce(speaker = turn_no % 2, false)) AS alternates FROM marked GROUP BY session),
kept AS (SELECT session FROM states WHERE bad_role = 0 AND bad_time = 0 AND unseen = 0 AND alternates AND messages % 2 = 0)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": _SQL + "SELECT session AS session_id, turn_no, id AS message_id FROM marked WHERE session IN (SELECT session FROM kept)",
        "p4_report": _SQL
        + """SELECT CASE WHEN session IN (SELECT session FROM kept) THEN 'kept' WHEN bad_role > 0 THEN 'bad_role' WHEN bad_time > 0 THEN 'bad_time'
  WHEN unseen > 0 THEN 'unseen_text' WHEN users <> assistants THEN 'missing_reply' ELSE 'not_alternating' END AS outcome,
  count(*) AS sessions, sum(messages) AS messages FROM states GROUP BY 1""",
    }
