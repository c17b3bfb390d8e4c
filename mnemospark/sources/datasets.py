"""Readers of public conversation-memory data sets into one shape, and writers of predictions.

documents: corpus, id, session, turn, role, text, at (epoch ms, null where unknown); tasks: corpus, id, category, query,
answer, gold ARRAY<STRING> (document ids).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _ms(timestamp: Column) -> Column:
    return F.unix_millis(timestamp)


def dotted_date(value: Column | str) -> Column:
    """'2023/05/20 (Sat) 02:21' as epoch ms, UTC; null for other shapes."""
    c = F.col(value) if isinstance(value, str) else value
    plain = F.regexp_replace(c, r"\s*\([A-Za-z]+\)\s*", " ")
    return _ms(F.try_to_timestamp(plain, F.lit("yyyy/MM/dd HH:mm")))


def spoken_date(value: Column | str) -> Column:
    """'1:56 pm on 8 May, 2023' as epoch ms, UTC; null for other shapes."""
    c = F.col(value) if isinstance(value, str) else value
    plain = F.regexp_replace(F.regexp_replace(c, r"(?i)\bam\b", "AM"), r"(?i)\bpm\b", "PM")
    return _ms(F.try_to_timestamp(plain, F.lit("h:mm a 'on' d MMMM, yyyy")))


_LONG = """question_id string, question_type string, question string, question_date string, answer string, haystack_dates array<string>,
haystack_session_ids array<string>, haystack_sessions array<array<struct<role:string,content:string,has_answer:string>>>, answer_session_ids array<string>"""


def long_memory(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A JSON array of questions with parallel arrays of dates, session ids and sessions.

    A session id that occurs again in a question gets '#2', '#3', ... . Gold: the turns flagged as holding the answer
    ('true' in any case), or all turns of the answer sessions if none is.
    """
    rows = spark.read.schema(_LONG).json(path, multiLine=True)
    s = rows.select("question_id", "answer_session_ids", F.posexplode(F.arrays_zip("haystack_dates", "haystack_session_ids", "haystack_sessions")).alias("pos", "s"))
    nth = F.row_number().over(Window.partitionBy("question_id", "s.haystack_session_ids").orderBy("pos"))
    named = s.withColumn("nth", nth).select("question_id", "answer_session_ids", F.col("s.haystack_session_ids").alias("source"), F.concat(F.col("s.haystack_session_ids"), F.when(F.col("nth") > 1, F.concat(F.lit("#"), F.col("nth").cast("string"))).otherwise("")).alias("session"), dotted_date(F.col("s.haystack_dates")).alias("at"), F.posexplode("s.haystack_sessions").alias("turn", "m"))
    turns = named.select(F.col("question_id").alias("corpus"), F.concat_ws(":", "question_id", "session", F.col("turn").cast("string")).alias("id"), "session", "turn", F.col("m.role").alias("role"), F.col("m.content").alias("text"), "at", (F.lower("m.has_answer") == "true").alias("flagged"), F.array_contains("answer_session_ids", F.col("source")).alias("in_answer"))
    gold = turns.groupBy(F.col("corpus").alias("id")).agg(F.array_sort(F.collect_list(F.when(F.col("flagged"), F.col("id")))).alias("flagged"), F.array_sort(F.collect_list(F.when(F.col("in_answer"), F.col("id")))).alias("answers"))
    tasks = rows.join(gold.withColumnRenamed("id", "question_id"), "question_id", "left").select(F.col("question_id").alias("corpus"), F.col("question_id").alias("id"), F.col("question_type").alias("category"), F.col("question").alias("query"), "answer", F.when(F.size("flagged") > 0, F.col("flagged")).otherwise(F.coalesce("answers", F.array().cast("array<string>"))).alias("gold"))
    return turns.select("corpus", "id", "session", "turn", "role", "text", "at"), tasks


_DIALOGUE = "sample_id string, conversation map<string,string>, qa array<struct<question:string,answer:string,evidence:array<string>,category:int>>"
_TURN = "array<struct<speaker:string,dia_id:string,text:string,blip_caption:string>>"
#: Names of the five question categories.
CATEGORIES = {1: "multi-hop", 2: "temporal", 3: "open-domain", 4: "single-hop", 5: "adversarial"}


def dialogue_memory(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A JSON array of samples whose conversation has keys session_<n> and session_<n>_date_time; questions without evidence are left out."""
    rows = spark.read.schema(_DIALOGUE).json(path, multiLine=True)
    entries = rows.select("sample_id", "conversation", F.explode("conversation").alias("key", "value")).where(F.col("key").rlike(r"^session_\d+$"))
    at = spoken_date(F.element_at("conversation", F.concat("key", F.lit("_date_time"))))
    turns = entries.select("sample_id", "key", at.alias("at"), F.posexplode(F.from_json("value", _TURN)).alias("turn", "t"))
    text = F.concat(F.col("t.text"), F.when(F.col("t.blip_caption").isNotNull(), F.concat(F.lit(" [photo: "), F.col("t.blip_caption"), F.lit("]"))).otherwise(""))
    documents = turns.select(F.col("sample_id").alias("corpus"), F.col("t.dia_id").alias("id"), F.col("key").alias("session"), "turn", F.col("t.speaker").alias("role"), text.alias("text"), "at")
    qa = rows.select("sample_id", F.posexplode("qa").alias("no", "q")).where(F.size("q.evidence") > 0)
    name = F.element_at(F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv]), F.col("q.category"))
    tasks = qa.select(F.col("sample_id").alias("corpus"), F.concat_ws(":", "sample_id", F.col("no").cast("string")).alias("id"), name.alias("category"), F.col("q.question").alias("query"), F.col("q.answer").alias("answer"), F.col("q.evidence").alias("gold"))
    return documents, tasks


_BANK = "profile map<string,string>, social_relationship map<string,map<string,string>>, events map<string,map<string,string>>, dialogues map<string,struct<contents:map<string,array<string>>>>"


def persona_memory(spark: SparkSession, path: str) -> DataFrame:
    """Documents of memory banks, one JSON object a person: profile facts, relations, events and dialogue lines."""
    bank = spark.read.schema(f"name string, {_BANK}").json(path, multiLine=True)
    facts = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "; ")
    one = lambda kind, df: df.select(F.col("name").alias("corpus"), F.concat_ws(":", F.lit(kind), "key").alias("id"), F.col("session"), F.lit(0).alias("turn"), F.lit(kind).alias("role"), "text", F.lit(None).cast("bigint").alias("at"))
    none = F.lit(None).cast("string").alias("session")
    profile = one("profile", bank.select("name", F.explode("profile").alias("key", "v")).select("name", "key", none, F.concat("key", F.lit(": "), "v").alias("text")))
    social = one("relation", bank.select("name", F.explode("social_relationship").alias("key", "v")).select("name", "key", none, facts(F.col("v")).alias("text")))
    events = one("event", bank.select("name", F.explode("events").alias("key", "v")).select("name", "key", none, facts(F.col("v")).alias("text")))
    talk = bank.select("name", F.explode("dialogues").alias("session", "d")).select("name", "session", F.explode("d.contents").alias("at", "lines")).select("name", "session", "at", F.posexplode("lines").alias("turn", "text"))
    dialogue = talk.select(F.col("name").alias("corpus"), F.concat_ws(":", F.lit("dialogue"), "session", "at", F.col("turn").cast("string")).alias("id"), "session", "turn", F.lit("dialogue").alias("role"), "text", _ms(F.try_to_timestamp(F.col("at"))).alias("at"))
    return profile.unionByName(social).unionByName(events).unionByName(dialogue)


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, health): parsed lines, and one row with lines, blank, broken."""
    lines = spark.read.text(path).select(F.trim("value").alias("line"))
    parsed = lines.select("line", F.from_json("line", f"{schema}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("r"))
    blank = F.col("line") == ""
    broken = ~blank & (F.col("r").isNull() | F.col("r._broken").isNotNull())
    health = parsed.agg(F.count(F.lit(1)).alias("lines"), F.count_if(blank).alias("blank"), F.count_if(broken).alias("broken"))
    return parsed.where(~blank & ~broken).select("r.*").drop("_broken"), health


def repaired_list(value: Column | str) -> Column:
    """A list that was stored as a JSON string, or that string's characters one by one, as the list it was."""
    c = F.col(value) if isinstance(value, str) else value
    joined = F.array_join(c, "")
    whole = F.size(F.filter(c, lambda x: F.length(x) > 1)) == 0
    return F.when((F.size(c) > 1) & whole & joined.startswith("["), F.from_json(joined, "array<string>")).when((F.size(c) == 1) & F.get(c, F.lit(0)).startswith("["), F.from_json(F.get(c, F.lit(0)), "array<string>")).otherwise(c)


def rendered_event(columns: list[str]) -> Column:
    """An event as one line of text: 'name=value' parts of the columns that aren't null."""
    return F.concat_ws(" | ", *[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c in columns])


def write_predictions(answers: DataFrame, path: str) -> None:
    """question_id, hypothesis as JSON lines."""
    answers.select("question_id", "hypothesis").write.mode("overwrite").json(path)


def write_documents(documents: DataFrame, path: str) -> None:
    """id, markdown as one text file a partition, documents separated by a blank line."""
    documents.orderBy("id").select(F.concat("markdown", F.lit("\n")).alias("value")).write.mode("overwrite").text(path)


_OFFICE = """task_id string, subtasks array<string>, chat_sessions_info struct<sessions:array<struct<session:string,date:string,user_requests:array<string>>>>,
memory_dependency struct<memory_chains:array<struct<subtask_index:int,related_memories:array<struct<date:string,text:string>>>>>"""


def artefact(subtask: Column | str) -> Column:
    """The header a subtask names, quoted or capitalised, in lower case; null if none."""
    c = F.col(subtask) if isinstance(subtask, str) else subtask
    quoted = F.regexp_extract(c, r"(?:new header(?: named)?|header)\s+'([^']+)'", 1)
    bare = F.regexp_extract(c, r"(?:new header(?: named)?|header)\s+([A-Z][\w ]*?)(?:,|\s+in\b|\s+to\b|$)", 1)
    name = F.lower(F.trim(F.when(quoted != "", quoted).otherwise(bare)))
    return F.when(name != "", name)


def office_memory(spark: SparkSession, path: str, grounded: bool) -> tuple[DataFrame, DataFrame]:
    """Task files with chat sessions and cited memories. A text is one document, its first place counts.

    Gold: the cited memories of the subtask, or (grounded) every document that names the subtask's artefact.
    """
    rows = spark.read.schema(_OFFICE).json(path, multiLine=True)
    s = rows.select("task_id", F.posexplode("chat_sessions_info.sessions").alias("n", "s")).select("task_id", "n", F.concat_ws("@", "s.session", "s.date").alias("session"), F.col("s.date").alias("date"), F.posexplode("s.user_requests").alias("p", "text"))
    said = s.select("task_id", F.concat_ws("#", "session", F.col("p").cast("string")).alias("id"), "session", (F.col("n") + 1).alias("turn"), "text", "date", F.lit(0).alias("part"), (F.col("n") * 100_000 + F.col("p")).alias("place"))
    m = rows.select("task_id", F.posexplode("memory_dependency.memory_chains").alias("n", "c")).select("task_id", "n", F.posexplode("c.related_memories").alias("p", "m"))
    cited = m.select("task_id", F.concat(F.lit("cited@"), F.col("m.date"), F.lit("#"), F.left("m.text", F.lit(24))).alias("id"), F.concat(F.lit("cited@"), F.col("m.date")).alias("session"), F.lit(None).cast("int").alias("turn"), F.col("m.text").alias("text"), F.col("m.date").alias("date"), F.lit(1).alias("part"), (F.col("n") * 100_000 + F.col("p")).alias("place"))
    first = F.row_number().over(Window.partitionBy("task_id", "text").orderBy("part", "place"))
    documents = said.unionByName(cited).withColumn("k", first).where("k = 1")
    out = documents.select(F.col("task_id").alias("corpus"), "id", "session", "turn", F.lit("user").alias("role"), "text", _ms(F.try_to_timestamp("date", F.lit("yyyy-MM-dd"))).alias("at"))
    asked = rows.select(F.col("task_id").alias("corpus"), F.posexplode("subtasks").alias("no", "query"))
    if grounded:
        named = asked.withColumn("artefact", artefact("query")).where("artefact IS NOT NULL")
        hits = named.join(out.select("corpus", F.col("id").alias("doc"), F.lower("text").alias("low")), "corpus").where("instr(low, artefact) > 0").select("corpus", "no", "doc")
    else:
        chains = rows.select(F.col("task_id").alias("corpus"), F.explode("memory_dependency.memory_chains").alias("c")).select("corpus", F.col("c.subtask_index").alias("no"), F.explode("c.related_memories.text").alias("text"))
        hits = chains.join(out.select("corpus", "text", F.col("id").alias("doc")), ["corpus", "text"]).select("corpus", "no", "doc")
    gold = hits.groupBy("corpus", "no").agg(F.array_sort(F.collect_set("doc")).alias("gold"))
    tasks = asked.join(gold, ["corpus", "no"]).select("corpus", F.concat_ws(":", "corpus", F.col("no").cast("string")).alias("id"), F.lit("office").alias("category"), "query", F.lit(None).cast("string").alias("answer"), "gold")
    return out, tasks


def selected_tasks(spark: SparkSession, directory: str, selection: str) -> DataFrame:
    """domain, id, instruction of the task files examples/<domain>/<id>.json that a selection (domain -> ids) names."""
    import json

    text = "\n".join(r[0] for r in spark.read.text(selection).collect())  # a hand-made list of task ids
    chosen = [(d, i) for d, ids in json.loads(text).items() for i in ids]
    paths = [f"{directory}/examples/{d}/{i}.json" for d, i in chosen]
    files = spark.read.schema("id string, instruction string").json(paths, multiLine=True)
    return files.join(spark.createDataFrame(chosen, "domain string, id string"), "id").select("domain", "id", "instruction")
