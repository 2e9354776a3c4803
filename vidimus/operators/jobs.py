"""Job state and index health (I). now is always passed in, as unix seconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, sanitised_error
from ..schemas import MODEL_INDEX_VERSION, SEARCH_INDEX_VERSION
from ..sources.discovery import plan_index_jobs

HIDDEN_TYPES = ("refresh_understanding", "refresh_index")
DAY = 86_400


def latest_logical_jobs(jobs: DataFrame, items: DataFrame | None = None, hidden: tuple[str, ...] = HIDDEN_TYPES) -> DataFrame:
    """One job for each item (or job without one) and type: running, queued, then the latest finished; hides refreshes and items being deleted."""
    rows = jobs.where(~F.col("job_type").isin(*hidden))
    if items is not None:
        rows = rows.join(items.where("status = 'deleting'").select(F.col("id").alias("item_id")), "item_id", "left_anti")
    state = F.when(F.col("status") == "running", 0).when(F.col("status") == "queued", 1).otherwise(2)
    order = Window.partitionBy(F.coalesce("item_id", "id"), "job_type").orderBy(state, F.desc(F.coalesce("finished_at", "started_at", F.lit(0))), F.desc("id"))
    return rows.withColumn("n_", F.row_number().over(order)).where("n_ = 1").drop("n_")


def job_summary(jobs: DataFrame, items: DataFrame) -> DataFrame:
    """One row: logical jobs by status, those that need attention (failed job of a failed item), refresh jobs in work."""
    failed = items.where("status = 'failed'").select(F.col("id").alias("item_id"), F.lit(True).alias("item_failed"))
    logical = latest_logical_jobs(jobs, items).join(failed, "item_id", "left")
    count = lambda c, name: F.count_if(c).alias(name)
    main = logical.agg(*[count(F.col("status") == s, s) for s in ("queued", "running", "completed", "failed", "cancelled")], count((F.col("status") == "failed") & F.coalesce("item_failed", F.lit(False)), "attention"))
    refresh = jobs.where(F.col("job_type").isin(*HIDDEN_TYPES)).agg(count(F.col("status").isin("queued", "running"), "refreshing"))
    return main.join(refresh)  # one row each


def list_jobs(jobs: DataFrame, now: int, statuses: list[str] | None = None, item: str | None = None, source_items: DataFrame | None = None, scope: str | None = None, order: str = "recent") -> DataFrame:
    """The drawer scope shows active jobs, those completed within a day and those failed within a week."""
    out = jobs if statuses is None else jobs.where(F.col("status").isin(*statuses))
    out = out if item is None else out.where(F.col("item_id") == item)
    out = out if source_items is None else out.join(source_items.select("item_id"), "item_id", "left_semi")
    if scope == "drawer":
        out = out.where(F.col("status").isin("queued", "running") | ((F.col("status") == "completed") & (F.col("finished_at") >= now - DAY)) | ((F.col("status") == "failed") & (F.col("finished_at") >= now - 7 * DAY)))
    when = F.coalesce("finished_at", "started_at", F.lit(0))
    state = F.when(F.col("status") == "running", 0).when(F.col("status") == "queued", 1).when(F.col("status") == "failed", 2).otherwise(3)
    return out.orderBy(*{"recent": [F.desc(when), F.desc("id")], "oldest": [F.asc(when), F.asc("id")], "status": [state, F.desc(when), F.desc("id")]}[order])


def stage_counts(jobs: DataFrame) -> DataFrame:
    """I4: running and queued jobs by stage, else by status."""
    return jobs.where(F.col("status").isin("running", "queued")).groupBy(F.coalesce("stage", "status").alias("stage")).agg(F.count("*").alias("n")).orderBy("stage")


def active_jobs(jobs: DataFrame, limit: int = 12) -> DataFrame:
    return jobs.where(F.col("status").isin("running", "queued")).orderBy(F.when(F.col("status") == "running", 0).otherwise(1), F.desc("started_at"), F.desc("id")).limit(limit)


def indexing_counts(items: DataFrame, jobs: DataFrame) -> DataFrame:
    """I4: one row: items by state of indexing, and active jobs."""
    of_items = items.agg(F.count_if(F.col("status") == "indexed").alias("indexed"), F.count_if(F.col("status").isin("discovered", "fetching", "processing")).alias("pending"), F.count_if(F.col("status") == "failed").alias("failed"))
    return of_items.join(jobs.agg(F.count_if(F.col("status").isin("running", "queued")).alias("active")))


# Parts of error messages. A rule is a code, the section of the settings, and words: any of them, together with all of
# the groups after it. "+dl" asks for a downloader's message, "-dl" for another's. The first rule that fits gives the code.
DOWNLOADER = ("yt-dlp", "[bilibili]", "[youtube]")
TROUBLE = ("could not", "cannot", "can't", "failed", "permission denied", "no such file", "unable")
COOKIE_LOAD = ("browser cookie load failed", "cookie database", "cookies database", "failed to decrypt", "unsupported browser", "keyring")
ERROR_RULES = [
    ("browser_cookies_required", "Indexing", [("sign in to confirm",), ("not a bot", "cookies")]),
    ("browser_cookies_unavailable", "Indexing", ["+dl", COOKIE_LOAD]),
    ("browser_cookies_unavailable", "Indexing", ["+dl", ("browser cookies", "cookies from browser"), TROUBLE]),
    ("members_only", "Indexing", [("members-only", "available to this channel's members", "channel's members")]),
    ("platform_verification_required", "Indexing", ["+dl", ("captcha", "geetest", "risk control", "risk-control", "http error 412", "412: precondition failed", "precondition failed", "风控", "验证码", "v_voucher", "verification required", "verify you are human")]),
    ("rate_limited", "Indexing", ["+dl", ("http error 429", "429: too many requests", "too many requests", "rate limit", "rate-limit", "限流")]),
    ("downloader_outdated", "About", [("yt-dlp",), ("update", "out of date", "outdated", "please update")]),
    ("download_forbidden", "Indexing", ["+dl", ("http error 401", "401: unauthorized", "unauthorized", "401")]),
    ("download_forbidden", "Indexing", [("http error 403", "403: forbidden")]),
    ("video_unavailable", "", [("this video is not available", "video unavailable")]),
    ("downloader_runtime_missing", "Indexing", [("no supported javascript runtime",)]),
    ("missing_api_key", "Models", ["-dl", ("api key", "missing key", "no key", "unauthorized", "401")]),
    ("model_not_found", "Models", [("model",), ("not found", "does not exist", "unsupported", "404")]),
    ("ffmpeg_unavailable", "Models", [("ffmpeg",)]),
    ("source_unavailable", "Sources", [("yt-dlp", "video unavailable", "private", "geo")]),
]
ERROR_CAPABILITIES = {"index_audio": "转录", "index_image": "图像索引", "index_video": "视频索引"}


def classify_job_errors(jobs: DataFrame) -> DataFrame:
    """error_code, settings_section and capability of each job's error; null for blank errors."""
    text = ascii_lower("error")

    def has(words: tuple[str, ...]) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | text.contains(w)
        return out

    code, section = F.lit("unknown_processing_error"), F.lit("")
    for name, where, groups in reversed(ERROR_RULES):
        fits = F.lit(True)
        for g in groups:
            fits = fits & (has(DOWNLOADER) if g == "+dl" else ~has(DOWNLOADER) if g == "-dl" else has(g))
        code, section = F.when(fits, name).otherwise(code), F.when(fits, where).otherwise(section)
    some = F.col("error").isNotNull() & (F.trim(F.regexp_replace("error", r"\s+", " ")) != "")
    capability = F.lit("索引")
    for kind, name in ERROR_CAPABILITIES.items():
        capability = F.when(F.col("job_type") == kind, name).otherwise(capability)
    return jobs.withColumn("error_code", F.when(some, code)).withColumn("settings_section", F.when(some, section)).withColumn("capability", F.when(some, capability))


def classify_media_failure(error: Column) -> Column:
    """missing_source or unreadable_media."""
    text = F.lower(error)
    missing = text.rlike("no such file|file not found|does not exist|missing source|source file")
    return F.when(missing, "missing_source").when(text.rlike("invalid data|moov atom|unsupported codec|could not decode|corrupt"), "unreadable_media")


STEADY_STAGES = ("queued", "fetching", "committing", "cancelling")
STAGE_STEPS = {"queued": 0, "fetching": 1, "sampling": 2, "transcribing": 3, "ocr": 4, "understanding": 5, "embedding": 6, "committing": 7}


def job_timing(jobs: DataFrame, now: int) -> DataFrame:
    """Elapsed, eta (from progress between 0.12 and 0.99, outside four stages) and percent by stage."""
    elapsed = F.greatest(F.lit(0), F.coalesce("finished_at", F.lit(now)) - F.col("started_at"))
    p = F.col("progress")
    eta = F.when((p >= 0.12) & (p < 0.99) & ~F.coalesce(F.col("stage").isin(*STEADY_STAGES), F.lit(False)), F.round(elapsed * (1 - p) / p).cast("long"))
    step = F.lit(None).cast("int")
    for name, k in STAGE_STEPS.items():
        step = F.when(F.col("stage") == name, k).otherwise(step)
    percent = F.when(F.col("status") == "completed", 100.0).otherwise(F.greatest(F.coalesce(p * 100, F.lit(0.0)), F.coalesce(step * 100.0 / len(STAGE_STEPS), F.lit(0.0))))
    return jobs.withColumn("elapsed", elapsed).withColumn("eta", F.when(F.col("status") == "running", eta)).withColumn("percent", percent)


def requeue_interrupted(jobs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """I8: running jobs are queued again; their items go back to indexed or discovered."""
    touched = jobs.where("status = 'running'").select(F.col("item_id").alias("id"), F.lit(True).alias("t_")).distinct()
    again = F.col("status") == "running"
    queued = jobs.withColumn("started_at", F.when(~again, F.col("started_at"))).withColumn("progress", F.when(again, 0.0).otherwise(F.col("progress"))).withColumn("status", F.when(again, "queued").otherwise(F.col("status")))
    back = items.join(touched, "id", "left").withColumn("status", F.when(F.col("t_") & F.col("status").isin("processing", "fetching"), F.when(F.col("indexed_at").isNotNull(), "indexed").otherwise("discovered")).otherwise(F.col("status"))).drop("t_")
    return queued, back


def cancel_queued(jobs: DataFrame, items: DataFrame, ids: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """The queued jobs in ids (id) and queued refreshes of their items are cancelled; an item without another active job is reset."""
    chosen = jobs.where("status = 'queued'").join(ids.select("id"), "id", "left_semi")
    with_items = chosen.select("item_id").distinct()
    siblings = jobs.where((F.col("status") == "queued") & F.col("job_type").isin(*HIDDEN_TYPES)).join(with_items, "item_id", "left_semi")
    gone = chosen.select("id").union(siblings.select("id")).distinct().withColumn("gone_", F.lit(True))
    out = jobs.join(gone, "id", "left").withColumn("finished_at", F.when(F.col("gone_"), now).otherwise(F.col("finished_at"))).withColumn("status", F.when(F.col("gone_"), "cancelled").otherwise(F.col("status"))).drop("gone_")
    active = out.where(F.col("status").isin("queued", "running")).select("item_id")
    free = with_items.join(active, "item_id", "left_anti").select(F.col("item_id").alias("id"), F.lit(True).alias("free_"))
    reset = items.join(free, "id", "left").withColumn("status", F.when(F.col("free_") & F.col("status").isin("processing", "fetching", "queued"), F.when(F.col("indexed_at").isNotNull(), "indexed").otherwise("discovered")).otherwise(F.col("status"))).drop("free_")
    return out, reset


def retry_failed(items: DataFrame, jobs: DataFrame, tables: dict[str, DataFrame], source: str | None = None) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """(items with the failed ones reset, the jobs planned for them, tables without their rows).

    tables are those whose rows a new run makes again (understandings, units, vectors), each with item_id; an item that has
    an active job gets no second one.
    """
    hit = (F.col("status") == "failed") if source is None else (F.col("status") == "failed") & (F.col("source_id") == source)
    hit = F.coalesce(hit, F.lit(False))
    again = items.where(hit)
    ids = again.select(F.col("id").alias("item_id"))
    reset = items.withColumn("error", F.when(~hit, F.col("error"))).withColumn("status", F.when(hit, "discovered").otherwise(F.col("status")))
    planned = plan_index_jobs(again.withColumn("status", F.lit("discovered")), jobs)
    return reset, planned, {name: table.join(ids, "item_id", "left_anti").select(table.columns) for name, table in tables.items()}


def repair_item_status(items: DataFrame, jobs: DataFrame, now: int) -> DataFrame:
    """Items whose artifacts say indexed become indexed, at their last completed job's end, else now."""
    done = jobs.where("status = 'completed'").groupBy(F.col("item_id").alias("id")).agg(F.max("finished_at").alias("done_"))
    says = F.get_json_object("metadata", "$.artifacts.status")
    off = F.coalesce((says == "indexed") & ~F.col("status").isin("indexed", "deleting"), F.lit(False))
    return items.join(done, "id", "left").withColumn("indexed_at", F.when(off, F.coalesce("indexed_at", "done_", F.lit(now))).otherwise(F.col("indexed_at"))).withColumn("status", F.when(off, "indexed").otherwise(F.col("status"))).drop("done_")


def items_needing_rebuild(items: DataFrame, version: int = SEARCH_INDEX_VERSION) -> DataFrame:
    """I12."""
    return items.where((F.coalesce("search_index_version", F.lit(0)) < version) | ~F.coalesce(F.col("search_index_status") == "indexed", F.lit(False))).where("status <> 'deleting'")


def index_health(items: DataFrame, chunks: DataFrame, units: DataFrame, vectors: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row of counts; a gap is units without points, drift is expected work beyond what is there."""
    n = lambda c, name: F.count_if(c).alias(name)
    s = F.col("status")
    of_items = items.agg(F.count("*").alias("items"), *[n(s == v, f"items_{v}") for v in ("indexed", "processing", "discovered", "failed", "deleting")], n(F.col("search_index_status") == "indexed", "search_indexed"), n(F.col("search_index_status") == "pending", "search_pending"), n(F.col("search_index_status") == "failed", "search_failed"), F.coalesce(F.sum("search_index_unit_count"), F.lit(0)).alias("expected_units"))
    of_chunks = chunks.agg(F.count("*").alias("chunks"), n(F.col("chunk_type").isin("keyframe", "image"), "frames"), n(F.col("text").isNull(), "chunks_without_text"))
    of_units = units.agg(F.count("*").alias("units"), n(F.col("unit_kind") == "image", "image_units"))
    of_vectors = vectors.agg(F.count("*").alias("points"), F.count_distinct("unit_id").alias("units_with_points"))
    of_jobs = jobs.agg(n(s == "running", "jobs_running"), n(s == "queued", "jobs_queued"), n(s == "failed", "jobs_failed"))
    orphans = orphan_jobs(jobs, items).agg(F.count("*").alias("orphan_jobs"))
    out = of_items.join(of_chunks).join(of_units).join(of_vectors).join(of_jobs).join(orphans)  # one row each
    gap = F.greatest(F.col("units") - F.col("points"), F.lit(0))
    drift = F.col("expected_units") > F.col("units")
    code = F.when(drift, "index_drift").when(gap > 0, "embedding_gap").when(F.col("search_failed") > 0, "index_failed")
    return out.withColumn("embedding_gap", gap).withColumn("drift", drift).withColumn("error_code", code)


def library_status(health: DataFrame, paused: bool = False, syncing: bool = False) -> DataFrame:
    """Mode (hybrid, text, vector or empty) and whether the index is settling."""
    text, vector = F.col("units") > 0, F.col("points") > 0
    mode = F.when(text & vector, "hybrid").when(text, "text").when(vector, "vector").otherwise("empty")
    work = (F.lit(False) if paused else (F.col("jobs_running") + F.col("jobs_queued")) > 0) | (F.col("search_pending") > 0) | F.lit(syncing)
    return health.select(mode.alias("mode"), text.alias("text_ready"), vector.alias("vectors_ready"), work.alias("index_settling"))


def orphan_jobs(jobs: DataFrame, items: DataFrame) -> DataFrame:
    """Jobs without an item; a null item_id counts."""
    return jobs.join(items.select(F.col("id").alias("item_id")), "item_id", "left_anti")


def missing_files(items: DataFrame, listing: DataFrame) -> DataFrame:
    """I16: items whose path is in no listing (path)."""
    return items.where("raw_path is not null").join(listing.select(F.col("path").alias("raw_path")).distinct(), "raw_path", "left_anti")


def recent_problems(jobs: DataFrame, items: DataFrame, limit: int = 20, home: str = "/Users") -> DataFrame:
    """The last errors of jobs and items, home folders redacted."""
    both = jobs.where("error is not null").select(F.lit("job").alias("kind"), "id", F.coalesce("finished_at", "started_at").alias("at"), "error")
    both = both.union(items.where("error is not null").select(F.lit("item"), "id", F.coalesce("indexed_at", "discovered_at"), "error"))
    return both.orderBy(F.desc("at"), "kind", "id").limit(limit).withColumn("error", sanitised_error("error", home))


def tombstone_removed(ignored: DataFrame, removed: DataFrame) -> DataFrame:
    """Removed (source_id, external_id, raw_path, ignored_at, reason) is merged in; an older path is kept."""
    new = removed.withColumn("external_id", F.coalesce("external_id", "raw_path")).groupBy("source_id", "external_id").agg(F.max_by(F.struct("ignored_at", "reason", "raw_path"), F.col("ignored_at")).alias("n"))
    out = ignored.join(new, ["source_id", "external_id"], "full_outer")
    return out.select("source_id", "external_id", F.coalesce("n.ignored_at", "ignored_at").alias("ignored_at"), F.coalesce("n.reason", "reason").alias("reason"), F.coalesce("raw_path", "n.raw_path").alias("raw_path"))


def remove_deleting_items(items: DataFrame, tables: dict[str, DataFrame]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Items being deleted go, and with them their rows."""
    gone = items.where("status = 'deleting'").select(F.col("id").alias("item_id"))
    return items.where("status <> 'deleting' or status is null"), cascade_delete(gone, tables)


def cascade_delete(ids: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Rows of the items in ids (item_id) leave every table; usage keeps its rows and loses the key."""
    out = {}
    for name, table in tables.items():
        if name == "usage":
            hit = ids.select("item_id", F.lit(True).alias("gone_")).distinct()
            out[name] = table.join(hit, "item_id", "left").withColumn("item_id", F.when(F.col("gone_").isNull(), F.col("item_id"))).drop("gone_").select(table.columns)
        else:
            out[name] = table.join(ids.select("item_id"), "item_id", "left_anti").select(table.columns)
    return out


def storage_usage(listing: DataFrame, categories: dict[str, str], total: int | None = None) -> DataFrame:
    """Bytes by category (name -> path prefix); other is the total less the known ones, at least 0."""
    kind = F.lit("other")
    for name, prefix in sorted(categories.items(), key=lambda c: len(c[1])):
        kind = F.when(F.col("path").startswith(prefix), name).otherwise(kind)
    used = listing.groupBy(kind.alias("category")).agg(F.sum("length").alias("bytes"))
    if total is None:
        return used
    known = used.where("category <> 'other'")
    return known.unionByName(known.agg(F.greatest(F.lit(total) - F.coalesce(F.sum("bytes"), F.lit(0)), F.lit(0)).cast("long").alias("bytes")).select(F.lit("other").alias("category"), "bytes"))


def retention_plan(listing: DataFrame, budget: int, exempt: DataFrame | None = None) -> DataFrame:
    """Files to remove, oldest first, while the rest is over the budget; paths in exempt (path) stay.

    Bytes are summed by day, and days by thousands: running sums are over the few thousands, the days of one and the files of
    one day, and no frame holds all rows.
    """
    rows = listing if exempt is None else listing.join(exempt.select("path"), "path", "left_anti")
    rows = rows.withColumn("day", F.floor(F.col("modified") / DAY))
    days = rows.groupBy("day").agg(F.sum("length").alias("bytes")).withColumn("era", F.floor(F.col("day") / 1000)).withColumn("one_", F.lit(1))
    eras = days.groupBy("era", "one_").agg(F.sum("bytes").alias("bytes"))
    earlier = lambda c, keys, order: F.coalesce(F.sum(c).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    eras = eras.select("era", earlier("bytes", ["one_"], ["era"]).alias("before"), F.sum("bytes").over(Window.partitionBy("one_")).alias("total"))
    days = days.join(eras, "era").select("day", "total", (F.col("before") + earlier("bytes", ["era"], ["day"])).alias("older"))
    placed = rows.withColumn("within", earlier("length", ["day"], ["modified", "path"])).join(days, "day")
    return placed.where(F.col("total") - F.col("older") - F.col("within") > budget).select(*listing.columns)


def schema_rebuild_plan(items: DataFrame, settings: DataFrame, version: int = MODEL_INDEX_VERSION, backend: str = "default") -> DataFrame:
    """All items if the stored version or backend (one row) differs, else none."""
    changed = settings.where((F.col("index_version") != version) | (F.col("backend") != backend)).limit(1).select(F.lit(True).alias("changed_"))
    return items.join(F.broadcast(changed)).drop("changed_")  # no row or one
