"""p3: skills that are slight reworkings of one another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm.neardup import near_duplicate_groups, near_duplicate_pairs
from mnemospark.llm.words import word_set, words_sql
from mnemospark.runtime import table

THRESHOLD = 0.75


def _skills(spark: SparkSession, d: str) -> DataFrame:
    """Each skill with the words of its title, description, steps and verification; resent rows are equal and count once."""
    s = table(spark, d, "experience_skills").select("id", "title", "description", "procedure_steps", "verification")
    text = F.concat_ws(" ", "title", "description", "procedure_steps", "verification")
    return s.select("id", word_set(text).alias("words"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicate_pairs(_skills(spark, d), THRESHOLD)


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicate_groups(_skills(spark, d), THRESHOLD)


def queries() -> dict:
    return {"p3_found": p3_found, "p3_groups": p3_groups}


#: All pairs.
_SETS = f"""s AS MATERIALIZED (SELECT id, {words_sql("any_value(concat_ws(' ', title, description, array_to_string(procedure_steps, ' '), array_to_string(verification, ' ')))")} AS w FROM experience_skills GROUP BY id),
p AS MATERIALIZED (SELECT a.id AS id_a, b.id AS id_b, len(list_intersect(a.w, b.w)) AS s, len(a.w) AS n, len(b.w) AS m FROM s a JOIN s b ON a.id < b.id WHERE len(a.w) > 0),
f AS MATERIALIZED (SELECT id_a, id_b, s = n AND s = m AS same FROM p WHERE s >= 0.75 * (n + m - s))"""

_GROUPS = f"""WITH RECURSIVE {_SETS}, l AS MATERIALIZED (SELECT id_a AS x, id_b AS y, same FROM f UNION ALL SELECT id_b, id_a, same FROM f),
c AS MATERIALIZED (SELECT s.id, least(s.id, min(y) FILTER (same)) AS class_id, 1 + count(y) FILTER (same) AS copies FROM s LEFT JOIN l ON x = s.id WHERE len(w) > 0 GROUP BY s.id),
r AS (SELECT id, id AS other FROM c UNION SELECT r.id, y FROM r JOIN l ON x = other), g AS (SELECT id, min(other) AS group_id FROM r GROUP BY id),
d AS (SELECT x AS id, count(DISTINCT k.class_id) AS links FROM l JOIN c k ON k.id = y WHERE NOT same GROUP BY x)
SELECT id, class_id, group_id, copies, coalesce(links, 0) AS links FROM c JOIN g USING (id) LEFT JOIN d USING (id) UNION ALL SELECT id, NULL, NULL, 1, 0 FROM s WHERE len(w) = 0"""


def oracle_sql() -> dict[str, str]:
    return {"p3_found": f"WITH {_SETS} SELECT id_a, id_b FROM f", "p3_groups": _GROUPS}
