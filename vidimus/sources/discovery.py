"""Listings, the merge of discovered items, job planning, event logs and sinks."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from ..functions import pointers
from ..functions.graphs import components
from ..functions.tables import stored
from ..functions.text import or_null

LISTING = "id string, display_id string, title string, duration double, platform string, source_kind string, source_url string, original_url string, webpage_url string"
EVENT_LOG = "ts long, level string, stage string, item_id string, job_id string, message string, fields string"


def read_video_listings(spark: SparkSession, path: str, defaults: dict[str, str] | None = None, most: int | None = None) -> DataFrame:
    """JSON lines of a listing to discovered rows: id or display_id required, fields added only where absent, listing order kept, cut at most."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("pos"))
    return video_listings(lines, defaults, most)


def video_listings(lines: DataFrame, defaults: dict[str, str] | None = None, most: int | None = None) -> DataFrame:
    """A6 on rows (value, file, pos)."""
    rows = lines.select("file", "pos", F.from_json("value", LISTING).alias("r")).select("file", "pos", "r.*")
    rows = rows.withColumn("external_id", F.coalesce("id", "display_id")).where("external_id is not null").drop("id", "display_id")
    for k, v in (defaults or {}).items():
        rows = rows.withColumn(k, F.coalesce(k, F.lit(v)))
    place = F.row_number().over(Window.partitionBy("file").orderBy("pos")) - 1
    rows = rows.withColumn("ord", place).drop("pos")
    return rows if most is None else rows.where(F.col("ord") < most)


def upsert_discovered(items: DataFrame, discovered: DataFrame, tombstones: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """(items, changed): discovered rows (source_id, external_id, raw_path, title, content_type, ord) are merged in, as if one after another by ord.

    Tombstoned ids or paths are left out; paths are compared without blanks at their ends, blank ones are none. A row updates
    the item with its (source, external id); else the one with its (source, path), preferring indexed, processing, fetching, then
    others, then the smaller id, which gets the new external id; else it is inserted. Items being deleted are never found by
    path. An exact match keeps indexed, a match by path keeps fetching and processing; others go back to discovered. changed
    (item_id) names the items whose external id changed, so whose chunks and units are to be cleared.

    Rows that share no id or path with another row, nor an item with one, are merged by joins at once; only the others are
    linked to components and merged in their order, component by component.
    """
    items, held = stored(items), items.columns
    new = discovered.withColumn("raw_path", F.col("raw_path").cast("string")).withColumn("path_", or_null("raw_path"))
    dead_ids, dead_paths = tombstones.select("source_id", "external_id"), tombstones.where("raw_path is not null").select("source_id", F.col("raw_path").alias("path_"))
    new = stored(new.join(dead_ids, ["source_id", "external_id"], "left_anti").join(dead_paths, ["source_id", "path_"], "left_anti"))
    # Keys of rows and of items: an id or a path of a source. Items link their two keys.
    id_key = lambda: F.to_json(F.struct(F.col("source_id").alias("s"), F.col("external_id").alias("e")))
    path_key = lambda c: F.when(F.col(c).isNotNull(), F.to_json(F.struct(F.col("source_id").alias("s"), F.col(c).alias("p"))))
    keyed = new.withColumns({"e_": id_key(), "p_": path_key("path_"), "row_": F.to_json(F.struct("source_id", "external_id", "ord", "raw_path"))})
    own = items.withColumns({"e_": F.when(F.col("external_id").isNotNull(), id_key()), "p_": path_key("raw_path")}).select("id", "e_", "p_")
    reach = keyed.select("row_", F.explode(F.array_compact(F.array("e_", "p_"))).alias("key"))
    sides = own.select("id", F.explode(F.array_compact(F.array("e_", "p_"))).alias("key"))
    touched = stored(sides.join(reach, "key").select("row_", "id").distinct())
    # A row is alone if its keys and items are no other row's.
    many_keys = reach.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    many_items = touched.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    tied = stored(reach.join(many_keys, "key", "left_semi").select("row_").union(touched.join(many_items, "id", "left_semi").select("row_")).distinct())
    alone = keyed.join(tied, "row_", "left_anti").drop("row_", "e_", "p_", "ord")
    merged, moved = _merged_alone(items, alone, now)
    if tied.isEmpty():
        return merged.select(held), moved
    rows = stored(keyed.join(tied, "row_", "left_semi"))
    mine = stored(own.join(touched.join(tied, "row_", "left_semi").select("id").distinct(), "id", "left_semi"))
    links = rows.select("e_", "p_").union(mine.select("e_", "p_")).select(F.coalesce("e_", "p_").alias("a"), F.coalesce("p_", "e_").alias("b"))
    roots = components(links)
    name = lambda df: df.withColumn("node", F.coalesce("e_", "p_")).join(roots, "node", "left").withColumn("root_", F.coalesce("root", "node")).drop("node", "root", "e_", "p_")
    ours = items.join(name(mine.select("id", "e_", "p_")), "id")
    schema = to_arrow_schema(items.schema).append(pa.field("moved_", pa.bool_()))
    folded = stored(ours.groupBy("root_").cogroup(name(rows).drop("row_").groupBy("root_")).applyInArrow(_in_order(schema, now), from_arrow_schema(schema)))
    rest = merged.join(folded.select("id"), "id", "left_anti")
    return rest.select(held).unionByName(folded.select(held)), moved.union(folded.where("moved_").select(F.col("id").alias("item_id")))


def _merged_alone(items: DataFrame, new: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """Rows that share nothing with each other, merged by joins."""
    new = new.select("source_id", "external_id", "path_", *[F.col(c).alias(f"new_{c}") for c in ("raw_path", "title", "content_type")])
    there = F.coalesce(F.col("status") != "deleting", F.lit(True))
    exact = new.join(items.select("source_id", "external_id", F.col("id").alias("hit"), there.alias("live")), ["source_id", "external_id"], "left")
    state = F.when(F.col("status") == "indexed", 0).when(F.col("status") == "processing", 1).when(F.col("status") == "fetching", 2).otherwise(3)
    by_path = items.where(there & F.col("raw_path").isNotNull()).groupBy("source_id", F.col("raw_path").alias("path_")).agg(F.min_by("id", F.struct(state, "id")).alias("path_hit"))
    met = exact.join(by_path, ["source_id", "path_"], "left")
    # An item with the id that is being deleted is taken again only if no other has the path.
    live = F.coalesce("live", F.lit(False))
    met = met.withColumn("moved", ~live & F.col("path_hit").isNotNull()).withColumn("id", F.coalesce(F.when(live, F.col("hit")), "path_hit", "hit", F.concat_ws(":", "source_id", "external_id")))
    met = met.drop("hit", "path_hit", "live", "path_").withColumnRenamed("external_id", "new_external_id").withColumnRenamed("source_id", "new_source_id")
    both = items.join(met, "id", "full_outer")
    seen, going = F.col("new_source_id").isNotNull(), F.col("status").isin("fetching", "processing")
    kept = F.coalesce(F.when(F.col("moved"), going).otherwise(F.col("status") == "indexed"), F.lit(False))
    put = {
        "source_id": F.coalesce("new_source_id", "source_id"), "external_id": F.coalesce("new_external_id", "external_id"), "title": F.when(seen, F.col("new_title")).otherwise(F.col("title")), "content_type": F.when(seen, F.col("new_content_type")).otherwise(F.col("content_type")),
        "raw_path": F.when(seen, F.col("new_raw_path")).otherwise(F.col("raw_path")), "status": F.when(seen & ~kept, "discovered").otherwise(F.col("status")), "discovered_at": F.coalesce("discovered_at", F.when(seen, F.lit(now))),
    }
    if "error" in items.columns:
        put["error"] = F.when(~seen, F.col("error"))
    if "indexed_at" in items.columns:
        put["indexed_at"] = F.when(~F.coalesce(F.col("moved") & ~going, F.lit(False)), F.col("indexed_at"))
    return both.withColumns(put).select(items.columns), met.where("moved").select(F.col("id").alias("item_id"))


def _in_order(schema: pa.Schema, now: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    ranks = {"indexed": 0, "processing": 1, "fetching": 2}

    def run(items: pa.Table, rows: pa.Table) -> pa.Table:
        """The items of one component with its rows merged in their order."""
        held = [{**x, "moved_": False} for x in items.drop_columns(["root_"]).to_pylist()]
        for r in sorted(rows.to_pylist(), key=lambda r: (r["ord"], r["external_id"] or "", r["raw_path"] or "")):
            same = [x for x in held if (x["source_id"], x["external_id"]) == (r["source_id"], r["external_id"])]
            at = [x for x in held if r["path_"] is not None and (x["source_id"], x["raw_path"]) == (r["source_id"], r["path_"]) and x["status"] != "deleting"]
            live = next((x for x in same if x["status"] != "deleting"), None)
            x = live
            if live is None and at:
                x = min(at, key=lambda x: (ranks.get(x["status"], 3), x["id"]))
                x["moved_"] = True
                if x["status"] not in ("fetching", "processing"):
                    x["status"] = "discovered"
                    if "indexed_at" in x:
                        x["indexed_at"] = None
            elif live is None and not same:
                name = f"{r['source_id']}:{r['external_id']}"
                while any(y["id"] == name for y in held):  # an item that had the external id before has been moved on
                    name += "'"
                held.append(x := {**dict.fromkeys(schema.names), "id": name, "source_id": r["source_id"], "status": "discovered", "moved_": False})
            else:
                x = live or same[0]
                x["status"] = "indexed" if x["status"] == "indexed" else "discovered"
            x.update({k: r[k] for k in ("external_id", "raw_path", "title", "content_type")})
            if "error" in x:
                x["error"] = None
            x["discovered_at"] = now if x["discovered_at"] is None else x["discovered_at"]
        return pa.Table.from_pylist(held, schema)

    return run


def plan_index_jobs(items: DataFrame, jobs: DataFrame, mode: str = "index") -> DataFrame:
    """(item_id, job_type, status) to queue: index items that aren't indexed; refresh and rebuild take indexed ones.

    An index or rebuild job is left out while one is queued or running, a refresh only while one is queued.
    """
    job_type = F.concat(F.lit("index_" if mode != "refresh" else "refresh_"), "content_type")
    wanted = items.where(F.coalesce(F.col("status") != "indexed", F.lit(True)) if mode == "index" else F.col("status") == "indexed").where(F.coalesce(F.col("status") != "deleting", F.lit(True)))
    wanted = wanted.select(F.col("id").alias("item_id"), job_type.alias("job_type"))
    active = jobs.where(F.col("status").isin(*(["queued"] if mode == "refresh" else ["queued", "running"]))).select("item_id", "job_type")
    return wanted.join(active, ["item_id", "job_type"], "left_anti").withColumn("status", F.lit("queued"))


def read_event_log(spark: SparkSession, path: str, now: int, streaming: bool = False) -> DataFrame:
    """JSON lines of events. A missing time is the time of reading: now, in a stream the time of the batch that reads the line."""
    reader = spark.readStream if streaming else spark.read
    read_at = F.unix_timestamp(F.current_timestamp()) if streaming else F.lit(now).cast("long")
    return reader.schema(EVENT_LOG).json(path).withColumn("ts", F.coalesce("ts", read_at))


def write_table(df: DataFrame, path: str, partitions: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    """Parquet; units and vectors are partitioned by index_version, large tables by a hash of their item."""
    df.write.mode(mode).partitionBy(*partitions).parquet(path)


def publish_snapshot(spark: SparkSession, base: str, number: int, tables: dict[str, tuple[DataFrame, tuple[str, ...]]], about: dict | None = None) -> bool:
    """Tables (name -> rows and partition columns) as one snapshot; a pointer makes it the current one when all are written.

    A run that fails half-way leaves the pointer on the last whole snapshot. Writers write to folders of their own; of several
    that publish the same number the first wins, the others get False and their folders are removed.
    """
    path = f"{base}/snapshot={number}-{uuid.uuid4().hex[:8]}"
    for name, (df, partitions) in tables.items():
        write_table(df, f"{path}/{name}", partitions)
    if pointers.claim(spark, base, number, {"path": path, **(about or {})}):
        return True
    pointers.remove(spark, path)
    return False


def current_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """A table of the snapshot that the pointer names."""
    return spark.read.parquet(f"{pointers.latest(spark, base)['path']}/{name}")


def merge_batch(spark: SparkSession, base: str, stream: str, batch: int, change: Callable[[dict | None], dict[str, tuple[DataFrame, tuple[str, ...]]]]) -> bool:
    """One batch of a stream merged into the tables of a snapshot, once: a batch that was merged before changes nothing.

    change(pointer) makes the new tables from the pointer of the current snapshot. Each pointer carries the last batch of every
    stream, so the tables and the mark of the batch become current together. Returns whether the batch was merged now.
    """
    while True:
        last = pointers.latest(spark, base)
        done = dict((last or {}).get("streams", {}))
        if done.get(stream, -1) >= batch:
            return False
        done[stream] = batch
        if publish_snapshot(spark, base, (last or {"number": 0})["number"] + 1, change(last), {"streams": done}):
            return True  # else another writer was first: its snapshot is taken up
