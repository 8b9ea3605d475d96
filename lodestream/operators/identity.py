"""From parsed listens to identified entities, daily facts, dimensions and quality counters.

Aliases (name -> id) are a snapshot per batch: names seen with given ids in the batch, and the known table; the
smallest (archive, member, line) wins. Names without alias get a derived id. An alias never points to a derived id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, day_from_unix, has_collab, json_list, norm_text, norm_token, recording_key, release_date, split_credit, uuid5


def identified(parsed: DataFrame) -> DataFrame:
    """One row per good line: day, seq, names, ids and keys."""
    tm, add = "rec.track_metadata", "rec.track_metadata.additional_info"
    first = lambda *names: F.coalesce(*[F.col(f"{add}.{n}") for n in names])
    names = F.concat(json_list(F.col(f"{add}.artist_names")), json_list(F.col(f"{add}.release_artist_names")), F.array_compact(F.array(F.col(f"{tm}.artist_name"))))
    names = F.array_distinct(F.flatten(F.transform(names, split_credit)))
    df = parsed.filter(~F.col("bad")).select(
        F.struct("archive", "member", "line_no").alias("seq"),
        day_from_unix(F.col("rec.timestamp")).alias("day"),
        F.array_distinct(json_list(F.col(f"{add}.artist_mbids"))).alias("mbids"),
        F.col(f"{add}.artist_mbids").isNull().alias("no_mbid_key"),
        F.array_compact(F.transform(names, lambda x: F.nullif(F.lower(F.trim(F.regexp_replace(x, r"(?U)\s+", " "))), F.lit("")))).alias("names"),
        F.col(f"{tm}.artist_name").alias("raw_artist"),
        norm_text(F.col(f"{tm}.artist_name")).alias("artist_name"),
        norm_text(F.col(f"{tm}.track_name")).alias("track_name"),
        norm_text(F.coalesce(F.col(f"{tm}.release_name"), F.col(f"{add}.release_name"))).alias("release_name"),
        blank_to_null(F.coalesce(first("recording_mbid"), F.get_json_object("line", "$.track_metadata.additional_info.Recording_mbid"))).alias("mbid"),
        F.coalesce(release_date(first("release_date", "first_release_date", "date", "year", "release_year", "original_release_date")), release_date(F.coalesce(f"{tm}.release_date", f"{tm}.first_release_date", f"{tm}.date"))).alias("release_date"),
    )
    return df.withColumn("recording_id", recording_key(F.col("mbid"), F.col("artist_name"), F.col("track_name"), F.col("release_name")))


def aliases(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """token, artist_id: names given together with ids, by position; first seen wins, the known table before all."""
    pairs = rows.filter("day is not null and size(mbids) > 0").select("seq", F.explode(F.arrays_zip("names", "mbids")).alias("p")).select("seq", F.col("p.names").alias("token"), F.col("p.mbids").alias("artist_id")).filter("token is not null and artist_id is not null")
    out = pairs.groupBy("token").agg(F.min_by("artist_id", "seq").alias("artist_id"))
    return out if known is None else known.unionByName(out.join(known, "token", "left_anti"))


def artists(rows: DataFrame, alias: DataFrame) -> DataFrame:
    """One row per line and artist: given ids, else each name's alias or derived id."""
    usable = rows.filter("day is not null and recording_id is not null and (size(mbids) > 0 or size(names) > 0)")
    given = usable.filter("size(mbids) > 0").select("seq", "day", F.posexplode("mbids").alias("pos", "artist_id"), "names").select("seq", "day", "artist_id", F.get("names", F.col("pos")).alias("name"), F.lit(False).alias("derived"))
    named = usable.filter("size(mbids) = 0").select("seq", "day", F.explode("names").alias("name")).join(alias.withColumnRenamed("token", "name"), "name", "left")
    named = named.select("seq", "day", F.coalesce("artist_id", F.concat(F.lit("fallback_artist::"), F.col("name"))).alias("artist_id"), "name", F.col("artist_id").isNull().alias("derived"))
    return given.unionByName(named).dropDuplicates(["seq", "artist_id"])


def facts(rows: DataFrame, keyed: DataFrame, min_day=None) -> tuple[DataFrame, DataFrame]:
    """Track and artist counts per day from ``min_day`` on; earlier lines still feed the dimensions."""
    keep = F.lit(True) if min_day is None else F.col("day") >= F.lit(min_day)
    usable = rows.filter("day is not null and recording_id is not null and (size(mbids) > 0 or size(names) > 0)")
    track = usable.filter(keep).groupBy("day", "recording_id").agg(F.count("*").alias("listen_count"))
    artist = keyed.filter(keep).groupBy("day", "artist_id").agg(F.count("*").alias("listen_count"))
    return track, artist


def dimension(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The first-seen row of each key by seq."""
    return rows.groupBy(key).agg(F.min_by(F.struct(*columns), "seq").alias("x")).select(key, "x.*")


def counters(parsed: DataFrame, rows: DataFrame) -> DataFrame:
    """Quality counters of a batch in one row."""
    a = parsed.agg(F.count("*").alias("lines_parsed"), F.count_if("bad").alias("bad_json"))
    dated = F.col("day").isNotNull()
    signal = (F.size("mbids") > 0) | (F.size("names") > 0)
    b = rows.agg(
        F.count_if(~dated).alias("missing_timestamp"),
        F.count_if(dated).alias("usable_rows"),
        F.count_if(dated & F.col("no_mbid_key")).alias("artist_mbids_missing_key"),
        F.count_if(dated & ~F.col("no_mbid_key") & (F.size("mbids") == 0)).alias("artist_mbids_empty_list"),
        F.count_if(dated & F.col("artist_name").isNull()).alias("artist_name_missing"),
        F.count_if(dated & has_collab(F.col("raw_artist"))).alias("rows_with_collab_markers"),
        F.count_if(dated & ~signal).alias("dropped_rows_missing_artist_signals"),
        F.count_if(dated & signal & F.col("mbid").isNotNull()).alias("used_recording_mbid"),
        F.count_if(dated & signal & F.col("mbid").isNull() & F.col("recording_id").isNotNull()).alias("used_fallback_key"),
        F.count_if(dated & signal & F.col("recording_id").isNull()).alias("dropped_missing_identity"),
    )
    return a.join(F.broadcast(b), F.lit(True))


def entities(rows: DataFrame, key: str, name: str, ids: str, alias: DataFrame | None = None) -> DataFrame:
    """The entities of each credit: key, pos, entity_id, entity_name, derived.

    Given ids (array ``ids``) and the names that the credit splits into are paired by position. An id without
    a name takes the name where there is just one; a name without an id takes its alias (``alias``: token, entity_id),
    else the id derived from it. Of repeated ids in a credit the first counts. ``key`` is unique.
    """
    given = F.array_distinct(F.filter(F.transform(F.coalesce(ids, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))
    df = rows.select(F.col(key), given.alias("__ids"), split_credit(F.col(name)).alias("__names"))
    df = df.select(key, F.size("__names").alias("__n"), F.get("__names", F.lit(0)).alias("__only"), F.posexplode(F.arrays_zip("__ids", "__names")).alias("pos", "__e"))
    df = df.select(key, "pos", "__n", "__only", F.col("__e.__ids").alias("__given"), F.col("__e.__names").alias("__name"))
    df = df.withColumn("__token", F.when(F.col("__given").isNull(), norm_token(F.col("__name"))))
    if alias is not None:
        known = alias.groupBy(F.col("token").alias("__token")).agg(F.min("entity_id").alias("__known"))
        df = df.join(known, "__token", "left")
    else:
        df = df.withColumn("__known", F.lit(None).cast("string"))
    df = df.select(
        key,
        "pos",
        F.coalesce("__given", "__known", uuid5(F.col("__name"))).alias("entity_id"),
        F.when(F.col("__name").isNotNull(), F.col("__name")).when(F.col("__n") == 1, F.col("__only")).alias("entity_name"),
        (F.col("__given").isNull() & F.col("__known").isNull()).alias("derived"),
    )
    return df.groupBy(key, "entity_id").agg(F.min("pos").alias("pos"), F.min_by(F.struct("entity_name", "derived"), "pos").alias("x")).select(key, "pos", "entity_id", "x.*")


def remap(rows: DataFrame, seq: str = "seq", entity: str = "entity_id", name: str = "name") -> DataFrame:
    """Old to new ids where a name is a credit of several: old_id, new_id, name, derived.

    Rows count in the order of ``seq`` (unique). The first name keeps the old id and stands for it from then on; a further
    name takes the id that it stands for at that row, else the id of the first row so named, else one derived from
    it. Ids whose names agree after normalisation become the first such id. Each step is one window per name or id.
    """
    rows = rows.select(F.col(seq).alias("seq"), F.col(entity).alias("old_id"), F.col(name).alias("name"))
    base = rows.withColumn("token", norm_token(F.col("name"))).filter("token <> '' and old_id is not null").groupBy("token").agg(F.min_by("old_id", "seq").alias("base"))
    parts = rows.select("seq", "old_id", "name", F.posexplode_outer(split_credit(F.col("name"))).alias("pos", "part"))
    parts = parts.select("seq", "old_id", F.coalesce("pos", F.lit(0)).alias("pos"), F.coalesce("part", "name").alias("name"), F.col("part").isNull().alias("whole"), F.lower(F.trim("part")).alias("token"))
    split = parts.filter("not whole").join(base, "token", "left")
    up_to = Window.partitionBy("token").orderBy("seq", "pos").rowsBetween(Window.unboundedPreceding, -1)
    stands = F.last(F.when(F.col("pos") == 0, F.col("old_id")), ignorenulls=True).over(up_to)
    asked = F.count(F.when(F.col("pos") > 0, 1)).over(up_to)
    split = split.withColumn("__stands", F.coalesce(stands, "base")).withColumn("__asked", asked)
    made = (F.col("pos") > 0) & F.col("__stands").isNull()
    split = split.select("seq", "pos", "old_id", F.when(F.col("pos") == 0, F.col("old_id")).otherwise(F.coalesce("__stands", uuid5(F.col("name")))).alias("new_id"), "name", (made & (F.col("__asked") == 0)).alias("derived"))
    every = split.unionByName(parts.filter("whole").select("seq", "pos", "old_id", F.col("old_id").alias("new_id"), "name", F.lit(False).alias("derived")))
    order = F.struct("seq", "pos")
    every = every.groupBy("old_id", "new_id").agg(F.min(order).alias("at"), F.min_by(F.struct("name", "derived"), order).alias("x")).select("at", "old_id", "new_id", "x.*")
    named = every.withColumn("key", norm_token(F.col("name"))).filter("key <> ''")
    first = named.groupBy("key").agg(F.min_by("new_id", "at").alias("canonical"), F.min("at").alias("first_at"))
    moved = named.join(first, "key").filter("at <> first_at").groupBy("new_id").agg(F.max_by("canonical", "at").alias("canonical"))
    out = every.join(moved, "new_id", "left").withColumn("to", F.coalesce("canonical", "new_id")).withColumn("derived", F.col("derived") & (F.col("to") == F.col("new_id")))
    return out.groupBy("old_id", "to").agg(F.min_by(F.struct("name", "derived"), "at").alias("x")).select("old_id", F.col("to").alias("new_id"), "x.*")
