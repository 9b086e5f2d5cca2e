"""Decision and cache stores."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .documents import KEYED, write_document
from .files import files_below
from .generations import Store

DECISION = "photo_id string, filename string, original_path string, ai_status string, final_decision string, decision_source string, decision_updated_at string, notes string"
CACHE = (
    "cache_key string, photo_id string, path string, file_size long, modified long, thumbnail_path string, phash string, sharpness double, exposure double, contrast double,"
    " global_blur_penalty double, face_detected boolean, face_count int, face_sharpness double, face_score double, person_detected boolean, body_sharpness double,"
    " body_blur_penalty double, subject_score double, final_score double, width int, height int, cluster_id string, ai_status string, analysis_mode string, analysis_size int,"
    " cache_version string, scoring_version string, analysis_error string"
)


def _text_if_there(spark: SparkSession, path: str) -> DataFrame:
    """value: the whole text of a file, or of each file of a folder; no rows where there is none."""
    try:
        return spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "value string")


def _objects(spark: SparkSession, path: str, record: str) -> DataFrame:
    """key, d: the objects of a JSON object by key, or of a file or folder of lines with an object each (key null).

    A missing or unreadable file or another root gives none.
    """
    whole, shape = _text_if_there(spark, path), f"struct<{_fields(record)}>"
    is_record = lambda text: F.coalesce(*[F.get_json_object(text, f"$.{n}") for n in ("photo_id", "cache_key", "path")]).isNotNull()
    keyed = whole.filter(~is_record("value")).select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "text")).filter(F.startswith(F.ltrim("text"), F.lit("{")))
    lines = whole.select(F.explode(F.split("value", "\n")).alias("text")).filter(F.rlike("text", F.lit(r"^\{.*\}\s*$"))).filter(is_record("text"))
    both = keyed.unionByName(lines.select(F.lit(None).cast("string").alias("key"), "text"))
    return both.select("key", F.from_json("text", shape).alias("d")).filter("d is not null")


def _fields(record: str) -> str:
    return re.sub(r"(\w+) ((?:struct<[^>]*>)|\w+)", r"\1:\2", record)


def decisions_from_json(spark: SparkSession, path: str) -> DataFrame:
    """Decisions of a JSON object keyed by id, or of lines as `decisions_to_json` gives them."""
    from ..functions.scalars import decision

    rows = _objects(spark, path, DECISION).select("key", "d.*")
    text = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(other))
    return rows.withColumns({
        "photo_id": F.coalesce(F.nullif(F.col("photo_id"), F.lit("")), "key"), "final_decision": decision(F.col("final_decision")), "ai_status": F.lower(text("ai_status", "review")),
        "filename": text("filename", ""), "original_path": text("original_path", ""), "decision_source": text("decision_source", "manual"), "notes": text("notes", ""),
    }).filter("photo_id is not null").drop("key")


_RECORD = (
    "cache_key string, photo_id string, path string, file_size long, mtime double, thumbnail_path string, phash string,"
    " technical struct<sharpness:double,exposure:double,contrast:double,global_blur_penalty:double>,"
    " face struct<face_detected:boolean,face_count:int,face_sharpness:double,face_score:double>,"
    " body struct<person_detected:boolean,body_sharpness:double,body_blur_penalty:double,subject_score:double>,"
    " final_score double, width int, height int, cluster_id string, ai_status string, analysis_mode string, analysis_size int, cache_version string, scoring_version string"
)


_GROUPS = {"technical": ("sharpness", "exposure", "contrast", "global_blur_penalty"), "face": ("face_detected", "face_count", "face_sharpness", "face_score"), "body": ("person_detected", "body_sharpness", "body_blur_penalty", "subject_score")}
_FLAT = ", ".join(c for c in CACHE.split(", ") if c.split()[0] in {n for names in _GROUPS.values() for n in names} | {"modified", "analysis_error"})


def _cache_rows(records: DataFrame) -> DataFrame:
    """Rows of CACHE from a column `r` of records, nested by group or flat; times become microseconds."""
    nested = {n: F.coalesce(F.col(f"r.{g}.{n}"), F.col(f"r.{n}")) for g, names in _GROUPS.items() for n in names}
    own = {"modified": F.coalesce(F.floor(F.col("r.mtime") * 1e6 + 0.5).cast("long"), F.col("r.modified"))}
    return records.select(*[(nested | own).get(c, F.col(f"r.{c}")).alias(c) for c in (x.split()[0] for x in CACHE.split(", "))])


def cache_from_json(spark: SparkSession, path: str) -> DataFrame:
    """The cache of a JSON object keyed by cache key, or of lines as `cache_to_json` gives them; entries that are no objects are left out."""
    parsed = _objects(spark, path, f"{_RECORD}, {_FLAT}")
    return _cache_rows(parsed.select(F.col("d").withField("cache_key", F.coalesce("d.cache_key", "key")).alias("r")))


def cache_from_files(spark: SparkSession, folder: str) -> DataFrame:
    """The older form: a folder with one JSON file per image; unreadable files are left out."""
    parsed = _text_if_there(spark, folder).select(F.from_json("value", f"struct<{_fields(_RECORD + ', ' + _FLAT)}>").alias("r"))
    return _cache_rows(parsed.filter("r is not null and r.path is not null"))


_ANALYSIS = (
    "path string, enable_body_scoring boolean, enable_person_detection boolean, score struct<technical:struct<sharpness:double,exposure:double,contrast:double,global_blur_penalty:double>,"
    "face:struct<face_detected:boolean,face_count:int,face_sharpness:double,face_score:double>,body:struct<person_detected:boolean,body_sharpness:double,body_blur_penalty:double,subject_score:double>,"
    "duplicate_penalty:double,final_score:double,reasons:array<string>>"
)


def analyses_from_files(spark: SparkSession, folder: str, body_scoring: bool = True, person_detection: bool = False) -> DataFrame:
    """key and the scores of the older per-image files that were made under these two switches; the key is the file's name without its suffix.

    A file without a score, of other switches or unreadable is a miss.
    """
    files = files_below(spark, folder, recursive=False, content=True).filter(F.endswith("file_name", F.lit(".json")))
    parsed = files.select(F.regexp_replace("file_name", r"\.json$", "").alias("key"), F.from_json(F.decode("content", "UTF-8"), _ANALYSIS).alias("r"))
    valid = parsed.filter(F.col("r.score").isNotNull() & (F.col("r.enable_body_scoring") == body_scoring) & (F.col("r.enable_person_detection") == person_detection))
    flat = [F.col(f"r.score.{g}.{n}").alias(n) for g, names in _GROUPS.items() for n in names]
    return valid.select("key", *flat, F.coalesce("r.score.duplicate_penalty", F.lit(0.0)).alias("duplicate_penalty"), "r.score.final_score", F.coalesce("r.score.reasons", F.array().cast("array<string>")).alias("reasons"))


def cache_to_json(cache: DataFrame) -> DataFrame:
    """key and record per cache row: the scores nested by group, the time in seconds; sorted by key."""
    grouped = {n for names in _GROUPS.values() for n in names} | {"modified"}
    flat = [c for c in (x.split()[0] for x in CACHE.split(", ")) if c not in grouped]
    record = F.struct(*flat, (F.col("modified") / 1e6).alias("mtime"), *[F.struct(*names).alias(g) for g, names in _GROUPS.items()])
    return cache.orderBy("cache_key").select(F.col("cache_key").alias("key"), F.to_json(record, {"ignoreNullFields": "false"}).alias("record"))


def decisions_to_json(decisions: DataFrame) -> DataFrame:
    """key and record per decision, sorted by id."""
    record = F.to_json(F.struct(*[c.split()[0] for c in DECISION.split(", ")]), {"ignoreNullFields": "false"})
    return decisions.orderBy("photo_id").select(F.col("photo_id").alias("key"), record.alias("record"))


def write_json_store(keyed: DataFrame, path: str) -> str:
    """One JSON object of `decisions_to_json` or `cache_to_json` rows, sorted by key; readers see the old one or the new one."""
    return write_document(keyed.withColumn("section", F.lit("")), path, [("", KEYED)], "key")


def _ddl(schema) -> str:
    return schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def stored(spark: SparkSession, path: str, schema) -> DataFrame:
    """The current rows of a store, empty where there is none yet."""
    return Store(spark, path, _ddl(schema)).read()


def replaced(rows: DataFrame, path: str) -> None:
    """Replace a store by rows that may have been read from it; a crash leaves the old rows or the new ones."""
    Store(rows.sparkSession, path, _ddl(rows.schema)).replace(rows)
