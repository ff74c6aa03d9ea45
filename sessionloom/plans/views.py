"""Ledger views over the given tables, in SQL both engines run unchanged, and record inputs derived from them."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PLAIN_SQL = """
SELECT CAST(conv_id AS STRING) AS session_id,
       CASE conv_id % 3 WHEN 0 THEN 'claude' WHEN 1 THEN 'cursor' ELSE 'codex' END AS tool,
       CAST(1700000000000 + conv_id * 10000000 + turn * 1000 AS BIGINT) AS ts_ms,
       role, text AS content,
       CAST(NULL AS STRING) AS tool_calls_json, CAST(NULL AS STRING) AS files_touched_json,
       CAST(NULL AS STRING) AS parent_id
FROM conversations
"""

# The given conversations hold none of the markers the distillers look for; this view adds them by rule.
AUGMENTED_SQL = """
SELECT CAST(conv_id AS STRING) AS session_id,
       CASE conv_id % 3 WHEN 0 THEN 'claude' WHEN 1 THEN 'cursor' ELSE 'codex' END AS tool,
       CAST(1700000000000 + conv_id * 10000000 + turn * 1000 AS BIGINT) AS ts_ms,
       role,
       CASE WHEN role = 'tool_result' THEN 'Error: step ' || (turn % 3) || ' failed' || chr(10) || text
            WHEN role = 'user' AND turn % 6 = 2 THEN '[{"type":"tool_result","content":"ok"}]'
            WHEN role = 'assistant' AND k = 3 THEN '[{"type":"text","text":"Planned step ' || turn || '. Is it done?"},{"type":"tool_use","name":"write_file","input":{"path":"src/f' || (conv_id % 9) || '.rs"}}]'
            WHEN role = 'assistant' AND k = 5 THEN text || chr(10) || '```rust' || chr(10) || 'fn x() {}' || chr(10) || '```' || chr(10) || 'Run the tests.'
            WHEN role = 'assistant' AND k = 4 THEN text || chr(10) || '```' || chr(10) || 'unclosed ' || turn
            WHEN role = 'assistant' AND k = 6 THEN 'Let me try approach 2 for item ' || (turn % 4) || chr(10) || text
            WHEN role = 'user' AND turn % 6 = 0 THEN 'TODO: check   item ' || (conv_id % 5) || chr(10) || text
            WHEN role = 'user' AND turn % 6 = 4 THEN text || ' Should we keep item ' || turn || '?'
            ELSE text END AS content,
       CASE WHEN role = 'assistant' AND k = 3 THEN '[{"input":{"path":"src/f' || (conv_id % 9) || '.rs"},"name":"write_file","type":"tool_use"}]' END AS tool_calls_json,
       CASE WHEN role = 'assistant' AND k = 3 AND conv_id % 10 = 0 THEN '[oops'
            WHEN role = 'assistant' AND k = 3 THEN '["src/f' || (conv_id % 9) || '.rs","src/lib' || (turn % 2) || '.rs"]' END AS files_touched_json,
       CAST(NULL AS STRING) AS parent_id
FROM (
  SELECT conv_id, turn, text,
         CASE WHEN role = 'system' OR (conv_id % 4 = 1 AND turn % 5 = 3) THEN 'tool_result' ELSE role END AS role,
         (conv_id + turn) % 7 AS k
  FROM conversations) b
"""

# Ten long sessions: every tenth conversation joined, so that the caps of the distillers are reached.
PROJECT_SQL = f"""
SELECT 'p' || (CAST(session_id AS BIGINT) % 10) AS session_id, tool, ts_ms, role, content, tool_calls_json,
       CASE WHEN files_touched_json LIKE '[oops%' THEN files_touched_json
            WHEN files_touched_json IS NOT NULL THEN '["src/f' || (CAST(session_id AS BIGINT) % 9) || '.rs","src/lib' || ((ts_ms // 1000) % 20) || '.rs"]' END
         AS files_touched_json,
       parent_id
FROM ({AUGMENTED_SQL}) a
"""

# A session per tool: logs longer than a rendered document.
TOOL_SQL = f"SELECT tool AS session_id, tool, ts_ms, role, content, tool_calls_json, files_touched_json, parent_id FROM ({PROJECT_SQL}) p"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _over(spark: SparkSession, sf_dir: str, name: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace(f"FROM {name}", "FROM {given}"), given=table(spark, sf_dir, name))


def plain_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, sf_dir, "conversations", PLAIN_SQL)


def augmented_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    escaped = AUGMENTED_SQL.replace("{", "{{").replace("}", "}}")
    return _over(spark, sf_dir, "conversations", escaped)


def project_ledger(spark: SparkSession, sf_dir: str, sql: str = PROJECT_SQL) -> DataFrame:
    sql = sql.replace("{", "{{").replace("}", "}}").replace(" // ", " div ")
    return _over(spark, sf_dir, "conversations", sql)


def tool_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project_ledger(spark, sf_dir, TOOL_SQL)


def event_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` read as a log of file changes."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("proj"), (F.col("user_id") % 5).cast("string")).alias("project"),
        F.concat(
            F.when(F.col("event_id") % 11 == 0, "target/").when(F.col("event_id") % 13 == 0, "a/b/c/d/e/f/g/").otherwise("src/"),
            F.col("event_type"), F.lit("/f"), F.col("event_id").cast("string"),
            F.when(F.col("event_id") % 2 == 0, ".jsonl").otherwise(".rs"),
        ).alias("path"),
        F.col("ts").alias("mtime"),
    )


def json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested-message records built from the augmented ledger, with damage by rule.

    ``n = 7 * conv_id + turn`` decides: 13 cut short, 17 no session, 19 no time, 23 unreadable time, 29 bookkeeping type, 31 a
    second record on the same line.
    """
    led = augmented_ledger(spark, sf_dir)
    conv = F.col("session_id").cast("bigint")
    turn = ((F.col("ts_ms") - 1700000000000 - conv * 10000000) / 1000).cast("bigint")
    n = F.col("n")
    hit = lambda k: n % k == 0
    led = led.withColumn("conv", conv).withColumn("turn", turn).withColumn("n", F.col("conv") * 7 + F.col("turn"))
    uuid = F.concat(F.col("session_id"), F.lit("-"), F.col("turn").cast("string"))
    parent = F.when(F.col("turn") > 0, F.concat(F.col("session_id"), F.lit("-"), (F.col("turn") - 1).cast("string")))
    is_array = F.startswith("content", F.lit("["))

    def line(content) -> "F.Column":
        head = [
            uuid.alias("uuid"),
            parent.alias("parentUuid"),
            F.when(~hit(17), F.col("session_id")).alias("sessionId"),
            F.when(hit(29), "summary").otherwise("say").alias("type"),
        ]
        iso = F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
        stamp = F.when(hit(19), None).when(hit(23), "yesterday").otherwise(iso)
        nested = F.struct(
            *head, stamp.alias("timestamp"), F.struct("role", content.alias("content")).alias("message")
        )
        number = F.when(~hit(19) & ~hit(23), F.col("ts_ms"))
        flat = F.struct(
            *head, number.alias("ts"), F.when(hit(23) & ~hit(19), "yesterday").alias("timestamp"), F.col("role"),
            content.alias("content"),
        )
        return F.when(F.col("turn") % 2 == 0, F.to_json(nested)).otherwise(F.to_json(flat))

    whole = F.when(is_array, line(F.try_parse_json("content"))).otherwise(line(F.col("content")))
    damaged = (
        F.when(hit(13), F.substring(whole, F.lit(1), F.length(whole) - 5))
        .when(hit(31), F.concat(whole, F.lit(' {"x":1}')))
        .otherwise(whole)
    )
    end = F.col("conv") * 100 + F.col("turn") + 1
    return led.select(
        F.lit("claude").alias("tool"),
        F.concat(F.lit("src"), (F.col("conv") % 4).cast("string")).alias("source_path"),
        (end - 1).alias("start_offset"),
        end.alias("end_offset"),
        damaged.alias("line"),
        F.lit(True).alias("is_complete"),
    )


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event-message records: four files, a ``session_meta`` before each conversation but every fifth, and user and assistant
    turns alternating between the schema without session id and the one with it."""
    led = augmented_ledger(spark, sf_dir)
    conv = F.col("session_id").cast("bigint")
    led = led.withColumn("conv", conv).withColumn(
        "turn", ((F.col("ts_ms") - 1700000000000 - F.col("conv") * 10000000) / 1000).cast("bigint")
    )
    source = F.concat(F.lit("rollout"), (F.col("conv") % 4).cast("string"))
    meta = F.when(
        (F.col("turn") == 0) & (F.col("conv") % 5 != 0),
        F.struct(
            (F.col("conv") * 1000).alias("at"),
            F.to_json(
                F.struct(
                    F.lit("session_meta").alias("type"),
                    F.struct(F.col("session_id").alias("id"), F.concat(F.lit("/work/"), source).alias("cwd")).alias("payload"),
                )
            ).alias("line"),
        ),
    )
    speaker = F.when(F.col("role") == "user", "user_message").when(F.col("role") == "assistant", "agent_message")
    iso = F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    new = F.to_json(
        F.struct(
            F.lit("event_msg").alias("type"), iso.alias("timestamp"),
            F.struct(speaker.alias("type"), F.col("content").alias("message")).alias("payload"),
        )
    )
    old = F.to_json(
        F.struct(
            F.lit("event_msg").alias("type"), "session_id", F.col("turn").alias("seq"), "role", "content",
            F.col("ts_ms").cast("string").alias("ts"), F.try_parse_json("tool_calls_json").alias("tool_calls"),
        )
    )
    event = F.struct(
        (F.col("conv") * 1000 + 10 + F.col("turn")).alias("at"),
        F.when((F.col("turn") % 2 == 0) & speaker.isNotNull(), new).otherwise(old).alias("line"),
    )
    both = F.filter(F.array(meta, event), lambda x: x.isNotNull())
    return led.select(source.alias("source_path"), F.explode(both).alias("r")).select(
        F.lit("codex").alias("tool"),
        "source_path",
        F.col("r.at").alias("start_offset"),
        (F.col("r.at") + 1).alias("end_offset"),
        F.col("r.line").alias("line"),
        F.lit(True).alias("is_complete"),
    )


def history_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt-history lines of the user turns; every ninth has no text."""
    led = plain_ledger(spark, sf_dir).filter("role = 'user'")
    conv = F.col("session_id").cast("bigint")
    text = F.when((F.col("ts_ms") / 1000).cast("bigint") % 9 == 0, "").otherwise(F.col("content"))
    line = F.to_json(F.struct("session_id", (F.col("ts_ms") / 1000).cast("bigint").alias("ts"), text.alias("text")))
    return led.select(
        F.lit("codex").alias("tool"),
        F.concat(F.lit("history"), (conv % 4).cast("string")).alias("source_path"),
        (F.col("ts_ms") - 1).alias("start_offset"),
        F.col("ts_ms").alias("end_offset"),
        line.alias("line"),
        F.lit(True).alias("is_complete"),
    )


def flat_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat ``{sessionId, role, content, ts}`` records; every seventeenth has a text for a time."""
    led = augmented_ledger(spark, sf_dir)
    conv = F.col("session_id").cast("bigint")
    bad = (F.col("ts_ms") / 1000).cast("bigint") % 17 == 0
    good_line = F.to_json(F.struct(F.col("session_id").alias("sessionId"), "role", "content", F.col("ts_ms").alias("ts")))
    bad_line = F.to_json(
        F.struct(F.col("session_id").alias("sessionId"), "role", "content", F.col("ts_ms").cast("string").alias("ts"))
    )
    return led.select(
        F.lit("cursor").alias("tool"),
        F.concat(F.lit("ws"), (conv % 4).cast("string")).alias("source_path"),
        (F.col("ts_ms") - 1).alias("start_offset"),
        F.col("ts_ms").alias("end_offset"),
        F.when(bad, bad_line).otherwise(good_line).alias("line"),
        F.lit(True).alias("is_complete"),
    )


def kv_documents(spark: SparkSession, sf_dir: str, turns: int | None = None) -> DataFrame:
    """Key-value documents, one workspace per conversation.

    Prompts are the user turns; there is one generation fewer than prompts; every third workspace has a second, later composer;
    every seventh workspace id is unsafe. ``turns``: as the documents were when conversations had no more turns than that.
    """
    conv = table(spark, sf_dir, "conversations")
    conv = conv if turns is None else conv.where(F.col("turn") < turns)
    grouped = (
        conv.groupBy("conv_id")
        .agg(
            F.array_sort(F.collect_list(F.when(F.col("role") == "user", F.struct("turn", "text")))).alias("asked"),
            F.array_sort(
                F.collect_list(F.struct(F.col("turn"), F.col("role"), F.col("text").alias("content")))
            ).alias("said"),
        )
        .withColumn("doc", F.col("conv_id").cast("string"))
        .withColumn(
            "workspace_id",
            F.concat(F.when(F.col("conv_id") % 7 == 0, "../ws").otherwise("ws"), F.col("doc")),
        )
        .withColumn("base_ms", 1700000000000 + F.col("conv_id") * 10000000)
    )
    place = F.struct(
        F.col("workspace_id").alias("id"),
        F.struct(F.concat(F.lit("/work/p"), F.col("conv_id").cast("string")).alias("fsPath")).alias("uri"),
    )
    composer = lambda suffix, late: F.struct(
        F.concat(F.lit("c"), F.col("doc"), F.lit(suffix)).alias("composerId"),
        (F.col("base_ms") + late).alias("lastUpdatedAt"),
        place.alias("workspaceIdentifier"),
    )
    all_composers = F.when(
        F.col("conv_id") % 3 == 0, F.array(composer("", 900000), composer("b", 950000))
    ).otherwise(F.array(composer("", 900000)))
    headers = F.to_json(F.struct(all_composers.alias("allComposers")))
    prompts = F.to_json(
        F.transform("asked", lambda x: F.struct(x["text"].alias("text"), F.lit(4).alias("commandType")))
    )
    times = F.slice(F.col("asked"), F.lit(1), F.greatest(F.size("asked") - 1, F.lit(0)))
    generations = F.to_json(
        F.transform(times, lambda x: F.struct((F.col("base_ms") + x["turn"] * 1000).alias("unixMs")))
    )
    messages = F.to_json(
        F.struct(
            F.array(
                F.struct(
                    F.concat(F.lit("c"), F.col("doc")).alias("composerId"),
                    F.col("conv_id").cast("string").alias("sessionId"),
                    F.transform(
                        "said",
                        lambda x: F.struct(
                            x["role"].alias("role"),
                            x["content"].alias("content"),
                            F.when(x["turn"] % 4 != 3, F.col("base_ms") + x["turn"] * 1000).alias("ts"),
                        ),
                    ).alias("messages"),
                )
            ).alias("composers")
        )
    )
    document = lambda key, value, ws: F.struct(ws.alias("workspace_id"), F.lit(key).alias("key"), value.alias("value"))
    ws, none = F.col("workspace_id"), F.lit(None).cast("string")
    docs = F.array(
        document("composer.composerHeaders", headers, none),
        document("aiService.prompts", prompts, ws),
        document("aiService.generations", generations, ws),
        document("composer.composerData", messages, none),
    )
    return grouped.select(F.explode(docs).alias("d")).select("d.workspace_id", "d.key", "d.value")


def legacy_documents(spark: SparkSession, sf_dir: str, turns: int | None = None) -> DataFrame:
    """Older document shapes: a generation pairs a user turn with the turn after it; prompts of odd turns lack an id."""
    conv = table(spark, sf_dir, "conversations")
    conv = conv if turns is None else conv.where(F.col("turn") < turns)
    grouped = conv.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("said")
    )
    sid = F.col("conv_id").cast("string")
    base = 1700000000000 + F.col("conv_id") * 10000000
    users = F.filter("said", lambda x: x["role"] == "user")
    generations = F.to_json(
        F.transform(
            users,
            lambda x: F.struct(
                F.concat(F.lit("gen-"), sid, F.lit("-"), x["turn"].cast("string")).alias("generationId"),
                sid.alias("sessionId"),
                (base + x["turn"] * 1000).alias("requestTs"),
                (base + x["turn"] * 1000 + 500).alias("responseTs"),
                x["text"].alias("userMessage"),
                F.concat(F.lit("re: "), x["text"]).alias("assistantMessage"),
            ),
        )
    )
    prompts = F.to_json(
        F.transform(
            users,
            lambda x: F.struct(
                F.when(x["turn"] % 4 == 0, F.concat(F.lit("prompt-"), sid, F.lit("-"), x["turn"].cast("string"))).alias("promptId"),
                sid.alias("sessionId"),
                (base + x["turn"] * 1000).alias("ts"),
                x["text"].alias("text"),
            ),
        )
    )
    document = lambda key, value: F.struct(F.lit(None).cast("string").alias("workspace_id"), F.lit(key).alias("key"), value.alias("value"))
    docs = F.array(document("aiService.generations", generations), document("aiService.prompts", prompts))
    composer = kv_documents(spark, sf_dir, turns).filter("key = 'composer.composerData'")
    return grouped.select(F.explode(docs).alias("d")).select("d.workspace_id", "d.key", "d.value").unionByName(composer)


# -- growing files --------------------------------------------------------------------------------------------------------------
GROWING_SOURCES = 64


def growing_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as lines of files that are written in two pieces: even turns, then odd ones."""
    line = F.concat_ws("|", F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role", F.replace("text", F.lit("\n"), F.lit(" ")))
    return table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") % GROWING_SOURCES).alias("source"), (F.col("turn") % 2).alias("half"), "conv_id", "turn", line.alias("line")
    )


def write_piece(lines: DataFrame, folder: str, piece: int) -> None:
    """Write the files as they are after a piece: the first ends inside the line that the second completes. A file is replaced as a whole, so a
    repeated task writes the same; what it held before is how the new one begins."""
    order = ["source", "half", "conv_id", "turn"]
    whole = lines.withColumn("data", F.concat("line", F.lit("\n")))
    if piece == 1:
        later = lines.where("half = 1").groupBy("source").agg(F.min_by(F.struct("half", "conv_id", "turn", "line"), F.struct("conv_id", "turn")).alias("r"))
        cut = later.select("source", "r.half", "r.conv_id", "r.turn", "r.line", F.substring("r.line", 1, 7).alias("data"))
        whole = whole.where("half = 0").unionByName(cut)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        source, temporary, out, written = None, None, None, 0

        def close() -> None:
            if out is not None:
                out.close()
                system.move(temporary, f"{root}/source={source}.txt")

        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != source:
                    close()
                    source, temporary = k, f"{root}/.{k}-{uuid.uuid4().hex}"
                    out = system.open_output_stream(temporary)
                out.write(data.encode())
                written += 1
        close()
        yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], names=["lines"])

    ordered = whole.repartition("source").sortWithinPartitions(*order).select("source", "data")
    ordered.mapInArrow(run, "lines bigint").write.format("noop").mode("overwrite").save()
