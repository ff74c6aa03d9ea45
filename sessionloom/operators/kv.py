"""Key-value transcripts: composer headers, prompts and generations.

Input is ``kv(store, workspace_id, key, value)``: one JSON document per row, ``workspace_id`` null for a store's global
documents. ``store`` names one installation and is part of every key; without that column there is one store.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions import variant as vr

# Document keys and limits.
HEADERS_KEY = "composer.composerHeaders"
PROMPTS_KEY = "aiService.prompts"
GENERATIONS_KEY = "aiService.generations"
COMPOSER_DATA_KEY = "composer.composerData"
KEYS = (HEADERS_KEY, PROMPTS_KEY, GENERATIONS_KEY, COMPOSER_DATA_KEY)
SAFE_ID = r"\A[A-Za-z0-9_-]{1,64}\z"


def is_safe_id(c: Column) -> Column:
    """P16."""
    return F.coalesce(c.rlike(SAFE_ID), F.lit(False))


def split_oversized(kv: DataFrame, cap: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents within the size cap in bytes, and reject rows for the others; without a cap all are kept."""
    too_big = F.lit(False) if cap is None else F.octet_length("value") > cap
    rejected = kv.filter(too_big).select(
        F.lit("cursor").alias("tool"),
        F.concat_ws("/", *[F.col(c) for c in _workspace(kv)], F.col("key")).alias("source_path"),
        F.lit(0).cast("bigint").alias("end_offset"),
        F.lit("value exceeds size cap").alias("reason"),
    )
    return kv.filter(~too_big | F.col("value").isNull()), rejected


def _workspace(df: DataFrame) -> list[str]:
    """Key columns of a workspace."""
    return ["store", "workspace_id"] if "store" in df.columns else ["workspace_id"]


def _documents(kv: DataFrame, key: str) -> DataFrame:
    return kv.filter(F.col("key") == key).withColumn("v", vr.parse_strict(F.col("value")))


def _id(item: Column, path: str) -> Column:
    return F.nullif(vr.item_string(item, path), F.lit(""))


def composers(kv: DataFrame) -> DataFrame:
    """Header documents flattened; composers without an id or a workspace are dropped."""
    item = F.col("item")
    store = _workspace(kv)[:-1]
    return (
        _documents(kv, HEADERS_KEY)
        .select(*store, F.posexplode(vr.as_array(vr.get(F.col("v"), ".allComposers"))).alias("pos", "item"))
        .select(
            *store,
            _id(item, ".composerId").alias("composer_id"),
            _id(item, ".workspaceIdentifier.id").alias("workspace_id"),
            F.coalesce(vr.item_string(item, ".workspaceIdentifier.uri.fsPath"), F.lit("")).alias("fs_path"),
            F.coalesce(vr.item_long(item, ".lastUpdatedAt"), F.lit(0)).alias("last_updated_ms"),
            "pos",
        )
        .filter("composer_id is not null and workspace_id is not null")
    )


def newest_composers(found: DataFrame, limit: int | None = None) -> DataFrame:
    """Composers, most recently updated first, all or a number of them; the first one's path is the active project."""
    ordered = found.orderBy(F.desc("last_updated_ms"), "pos", "composer_id")
    return ordered if limit is None else ordered.limit(limit)


def owning_composer(found: DataFrame) -> DataFrame:
    """The composer that reads a workspace is its most recently updated one, so a shared workspace is read once."""
    order = F.struct(F.col("last_updated_ms"), -F.col("pos"), F.col("composer_id"))
    return (
        found.filter(is_safe_id(F.col("workspace_id")))
        .groupBy(*_workspace(found))
        .agg(F.max_by(F.struct("composer_id", "fs_path", "last_updated_ms"), order).alias("c"))
        .select(*_workspace(found), "c.*")
    )


def workspace_prompts(kv: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """New prompts of every workspace with their time.

    ``seen(workspace_id, n_seen, last_text)`` is the state of the previous read. A prompt takes the time of the generation at the
    same position, else the composer's. Both arrays live in one row per workspace, so pairing them needs no join of exploded rows.
    """
    text_of = lambda x: vr.item_string(x, ".text")
    keys = _workspace(kv)
    prompts = _documents(kv, PROMPTS_KEY).select(
        *keys, F.transform(vr.as_array(vr.get(F.col("v"))), text_of).alias("texts")
    )
    times = F.transform(vr.as_array(vr.get(F.col("v"))), lambda x: vr.item_long(x, ".unixMs"))
    generations = _documents(kv, GENERATIONS_KEY).select(
        *keys, F.filter(times, lambda t: t.isNotNull()).alias("times")
    )
    owner = owning_composer(composers(kv))
    joined = owner.join(prompts, keys).join(generations, keys, "left")
    if seen is None:
        joined = joined.withColumn("n_seen", F.lit(0)).withColumn("last_text", F.lit(None).cast("string"))
    else:
        joined = joined.join(seen, keys, "left").withColumn("n_seen", F.coalesce("n_seen", F.lit(0)))
    size = F.size("texts")
    back = F.array_position(F.reverse("texts"), F.col("last_text"))
    resume = F.when(F.col("last_text").isNull(), F.least(F.col("n_seen"), size)).otherwise(
        F.when(back > 0, size - back + 1).otherwise(0)
    )
    return (
        joined.withColumn("resume", resume.cast("int"))
        .select("*", F.posexplode("texts").alias("pos", "text"))
        .filter("pos >= resume and text is not null and text <> ''")
        .select(
            *keys,
            "composer_id",
            "fs_path",
            F.col("pos").cast("bigint").alias("pos"),
            "text",
            F.coalesce(F.get("times", F.col("pos")), F.col("last_updated_ms")).alias("ts_ms"),
        )
    )


def workspace_state(kv: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """State to keep for the next read: prompts seen so far and the last prompt of the array."""
    keys = _workspace(kv)
    prompts = _documents(kv, PROMPTS_KEY).select(
        *keys, F.transform(vr.as_array(vr.get(F.col("v"))), lambda x: vr.item_string(x, ".text")).alias("texts")
    )
    owned = prompts.join(owning_composer(composers(kv)).select(*keys), keys, "left_semi")
    now = owned.select(
        *keys,
        F.size("texts").alias("n_now"),
        F.when(F.size("texts") > 0, F.element_at("texts", -1)).alias("text_now"),
    )
    if seen is None:
        return now.select(*keys, F.col("n_now").alias("n_seen"), F.col("text_now").alias("last_text"))
    return now.join(seen, keys, "full").select(
        *keys,
        F.coalesce("n_now", "n_seen").alias("n_seen"),
        F.coalesce("text_now", "last_text").alias("last_text"),
    )


def _turn(store: list[str], session: Column, role: Column, content: Column, ts: Column, msg_id: Column, key: str) -> list[Column]:
    return [
        *[F.col(c) for c in store],
        F.coalesce(session, F.lit("")).alias("session_id"),
        F.lit("cursor").alias("tool"),
        F.coalesce(ts, F.lit(0)).alias("ts_ms"),
        role.alias("role"),
        content.alias("content"),
        msg_id.alias("msg_id"),
        F.lit(key).alias("source_key"),
    ]


def legacy_generations(kv: DataFrame) -> DataFrame:
    """Every generation is a user turn and an assistant turn."""
    item, side, store = F.col("item"), F.col("side"), _workspace(kv)[:-1]
    text = lambda path: F.coalesce(vr.item_string(item, path), F.lit(""))
    sides = F.array(
        F.struct(F.lit("user").alias("role"), text(".userMessage").alias("text"), vr.item_long(item, ".requestTs").alias("ts")),
        F.struct(
            F.lit("assistant").alias("role"), text(".assistantMessage").alias("text"), vr.item_long(item, ".responseTs").alias("ts")
        ),
    )
    return (
        _documents(kv, GENERATIONS_KEY)
        .select(*store, F.explode(vr.as_array(vr.get(F.col("v")))).alias("item"))
        .select(*store, "item", F.explode(sides).alias("side"))
        .select(
            *_turn(
                store,
                vr.item_string(item, ".sessionId"),
                side["role"],
                side["text"],
                side["ts"],
                F.concat(text(".generationId"), F.lit(":"), side["role"]),
                GENERATIONS_KEY,
            )
        )
    )


def legacy_prompts(kv: DataFrame) -> DataFrame:
    """Prompts that carry an id."""
    item, store = F.col("item"), _workspace(kv)[:-1]
    return (
        _documents(kv, PROMPTS_KEY)
        .select(*store, F.explode(vr.as_array(vr.get(F.col("v")))).alias("item"))
        .filter(_id(item, ".promptId").isNotNull())
        .select(
            *_turn(
                store,
                vr.item_string(item, ".sessionId"),
                F.lit("user"),
                F.coalesce(vr.item_string(item, ".text"), F.lit("")),
                vr.item_long(item, ".ts"),
                F.concat(_id(item, ".promptId"), F.lit(":user")),
                PROMPTS_KEY,
            )
        )
    )


def legacy_composer_messages(kv: DataFrame) -> DataFrame:
    """P20: messages of composer documents, numbered within their composer."""
    item, message, store = F.col("item"), F.col("message"), _workspace(kv)[:-1]
    return (
        _documents(kv, COMPOSER_DATA_KEY)
        .select(*store, F.explode(vr.as_array(vr.get(F.col("v"), ".composers"))).alias("item"))
        .select(*store, "item", F.posexplode(F.try_variant_get(item, "$.messages", "array<variant>")).alias("idx", "message"))
        .select(
            *_turn(
                store,
                vr.item_string(item, ".sessionId"),
                F.coalesce(vr.item_string(message, ".role"), F.lit("user")),
                vr.content_text(F.try_variant_get(message, "$.content", "variant")),
                vr.item_long(message, ".ts"),
                F.concat(
                    F.coalesce(vr.item_string(item, ".composerId"), F.lit("")), F.lit(":msg:"), F.col("idx").cast("string")
                ),
                COMPOSER_DATA_KEY,
            )
        )
    )


def legacy_turns(kv: DataFrame) -> DataFrame:
    """X2."""
    return legacy_generations(kv).unionByName(legacy_prompts(kv)).unionByName(legacy_composer_messages(kv))
