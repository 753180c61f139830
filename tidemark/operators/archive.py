"""Materialized archives: merge, snapshot diff, watermarks, verification, statistics, rendering, atomic publication."""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.sources.stores import Store

OVERLAP, MOST_OVERLAP = 86_400, 31 * 86_400


def export_key(server_id: Column, shard_local: Column, basis: Column, content: Column) -> Column:
    """The key of an archived message: server id, else shard-local identity, else a hash of its basis, else of its content."""
    return F.coalesce(F.concat(F.lit("server:"), S.present_id(server_id)), F.concat(F.lit("local:"), shard_local), F.concat(F.lit("basis:"), F.sha2(basis, 256)), F.concat(F.lit("content:"), F.sha2(content, 256)))


def merged(existing: DataFrame, incoming: DataFrame, key: str, digest: str) -> DataFrame:
    """MERGE by key: new rows are added, rows of another digest replaced, equal ones kept as they are, vanished ones retained.

    Adds ``change``: added, updated, same or retained. One full outer join on the key.
    """
    cols = [c for c in existing.columns if c != key]
    a = existing.select(F.col(key).alias("_a"), F.struct(*cols).alias("_old"))
    b = incoming.select(F.col(key).alias("_b"), F.struct(*cols).alias("_new"))
    j = a.join(b, F.col("_a") == F.col("_b"), "full_outer")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "retained").when(F.col(f"_old.{digest}").eqNullSafe(F.col(f"_new.{digest}")), "same").otherwise("updated")
    pick = F.when(F.col("_b").isNotNull() & change.isin("added", "updated"), F.col("_new")).otherwise(F.col("_old"))
    return j.select(F.coalesce("_a", "_b").alias(key), pick.alias("_r"), change.alias("change")).select(key, "_r.*", "change")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, change): new, updated, same or removed between two full snapshots."""
    j = old.select(F.col(key).alias("_a"), F.col(digest).alias("_x")).join(new.select(F.col(key).alias("_b"), F.col(digest).alias("_y")), F.col("_a") == F.col("_b"), "full_outer")
    change = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "removed").when(F.col("_x").eqNullSafe(F.col("_y")), "same").otherwise("updated")
    return j.select(F.coalesce("_a", "_b").alias(key), change.alias("change"))


def watermarks(rows: DataFrame, seq: str, time: str, overlap: int = OVERLAP) -> DataFrame:
    """One row: the largest sequence and time, and the sequence from which a replay must start.

    The floor is the least sequence among rows inside the overlap or without a time; without any, the largest.
    """
    if not 0 < overlap <= MOST_OVERLAP:
        raise ValueError("overlap out of range")
    top = rows.agg(F.max(seq).alias("max_seq"), F.max(time).alias("max_time"))
    near = rows.crossJoin(F.broadcast(top)).agg(F.first("max_seq").alias("s"), F.first("max_time").alias("t"), F.min(F.when(F.col(time).isNull() | (F.col(time) >= F.col("max_time") - overlap), F.col(seq))).alias("floor"))
    return near.select(F.col("s").alias("max_seq"), F.col("t").alias("max_time"), F.coalesce("floor", "s").alias("replay_floor"))


def folded_watermark(rows: DataFrame, seq: str, previous: int | None, complete_first_page: bool) -> int | None:
    """The next watermark; it moves on a complete first page only, and never back."""
    if not complete_first_page:
        return previous
    top = rows.agg(F.max(seq)).head()[0]
    return previous if top is None else top if previous is None else max(previous, top)


def sync_mode(state: dict | None, fingerprint: str, sources: int, catalog_same: bool, identity_same: bool, full: bool = False) -> str:
    """no_change, full, incremental_by_sequence, incremental_by_time, sender_identity_reconcile."""
    if state is None or full:
        return "full"
    if not identity_same:
        return "sender_identity_reconcile"
    if state.get("fingerprint") == fingerprint:
        return "no_change"
    return "incremental_by_sequence" if sources == 1 and catalog_same and state.get("max_seq") is not None else "incremental_by_time"


def remapped_keys(old: DataFrame, new: DataFrame, basis: str, key: str) -> DataFrame:
    """Old keys with the new keys of the same basis; any basis that isn't one to one fails the query."""
    a, b = (d.groupBy(basis).agg(F.min(key).alias("k"), F.count(F.lit(1)).alias("c")) for d in (old, new))
    j = a.select(basis, F.col("k").alias("old_key"), F.col("c").alias("ca")).join(b.select(F.col(basis).alias("_b"), F.col("k").alias("new_key"), F.col("c").alias("cb")), F.col(basis) == F.col("_b"))
    return j.where(F.when((F.col("ca") == 1) & (F.col("cb") == 1), True).otherwise(F.raise_error(F.lit("key_remap_not_unique")).cast("boolean"))).select("old_key", "new_key")


def downgraded(rows: DataFrame, rechecked: DataFrame, key: str) -> DataFrame:
    """Attributions that the last reconciliation could not check again become unknown."""
    seen = rechecked.select(F.col(key).alias("_k")).distinct()
    j = rows.join(seen, F.col(key) == F.col("_k"), "left")
    gone = F.col("_k").isNull() & F.col("sender_role").isin("self", "other")
    return j.withColumn("sender_role", F.when(gone, "unknown").otherwise(F.col("sender_role"))).withColumn("sender_username", F.when(gone, None).otherwise(F.col("sender_username"))).drop("_k")


def repairable(messages: DataFrame, key: str) -> DataFrame:
    """(key, item) of media that still lack a file; nothing else is read again."""
    return messages.select(key, F.posexplode_outer("media").alias("item_no", "item")).where(F.col("item").isNotNull() & (F.coalesce("item.openable", F.lit(False)) == False))  # noqa: E712


def repaired(messages: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """Messages whose media items are replaced by ``found`` (key, item_no, item); others stay in place."""
    items = messages.select(key, F.posexplode("media").alias("item_no", "item"))
    f = found.select(F.col(key).alias("_k"), F.col("item_no").alias("_n"), F.col("item").alias("_item"))
    new = items.join(f, (F.col(key) == F.col("_k")) & (F.col("item_no") == F.col("_n")), "left").select(key, F.struct("item_no", F.coalesce("_item", "item").alias("item")).alias("s"))
    back = new.groupBy(F.col(key).alias("_mk")).agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["item"]).alias("_media"))  # a message's items
    return messages.join(back, F.col(key) == F.col("_mk"), "left").withColumn("media", F.coalesce("_media", "media")).drop("_mk", "_media")


def media_counts(messages: DataFrame) -> DataFrame:
    return messages.select(F.explode("media").alias("m")).groupBy("m.kind").agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("m.openable")).alias("openable"))


def gap_counts(gaps: DataFrame, *keys: str) -> DataFrame:
    return gaps.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def delivery_status(gaps: DataFrame) -> str:
    return "partial" if gaps.limit(1).count() else "success"


def content_addressed(media: DataFrame, digest: str = "sha256", ext: str = "ext") -> DataFrame:
    """One row per content: its path and how often it is used; one digest with two sizes is a conflict and fails the query."""
    g = media.groupBy(digest, ext).agg(F.count(F.lit(1)).alias("uses"), F.min("size").alias("size"), F.max("size").alias("_hi"))
    g = g.where(F.when(F.col("size").eqNullSafe(F.col("_hi")), True).otherwise(F.raise_error(F.lit("media_content_conflict")).cast("boolean"))).drop("_hi")
    return g.withColumn("path", F.concat(F.lit("media/"), F.substring(digest, 1, 2), F.lit("/"), F.col(digest), F.lit("."), F.col(ext)))


def verify(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """(path, error): missing, size_mismatch, hash_mismatch or undeclared; declared and actual: path, size, sha256."""
    j = declared.select(F.col("path").alias("_d"), F.col("size").alias("_ds"), F.col("sha256").alias("_dh")).join(actual.select(F.col("path").alias("_p"), F.col("size").alias("_as"), F.col("sha256").alias("_ah")), F.col("_d") == F.col("_p"), "full_outer")
    error = (
        F.when(F.col("_p").isNull(), "missing").when(F.col("_d").isNull(), "undeclared").when(~F.col("_ds").eqNullSafe(F.col("_as")), "size_mismatch").when(~F.col("_dh").eqNullSafe(F.col("_ah")), "hash_mismatch")
    )
    return j.select(F.coalesce("_d", "_p").alias("path"), error.alias("error")).where("error is not null")


def dangling(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Relations whose target is missing."""
    return children.join(parents.select(key).distinct(), key, "left_anti")


def error_codes(errors: DataFrame) -> DataFrame:
    return errors.agg(F.sort_array(F.collect_set("error")).alias("errors"))


def file_facts(spark, root: str) -> DataFrame:
    """(path, size, sha256) of the files below a folder, hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(F.expr(f"substring(path, instr(path, '{Path(root).name}/') + {len(Path(root).name) + 1})").alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def known_sum(field: str) -> Column:
    """A sum over rows that all report the field; null if any doesn't."""
    return F.when(F.count(field) == F.count(F.lit(1)), F.sum(field))


def statistics(manifests: DataFrame) -> DataFrame:
    """Over an archive catalog: archives, messages, media where all report them, the latest sync."""
    return manifests.agg(F.count(F.lit(1)).alias("archives"), known_sum("messages").alias("messages"), known_sum("media").alias("media"), F.max("synced_at").alias("latest"))


def counted_map(df: DataFrame, key: str) -> DataFrame:
    """Counts by a key of few values as one sorted map."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, "n")))).alias("counts"))


def text_size(spark, glob: str) -> DataFrame:
    t = spark.read.text(glob, wholetext=True)
    return t.agg(F.count(F.lit(1)).alias("files"), F.sum(F.char_length("value")).alias("chars"), F.sum(F.regexp_count("value", F.lit("\n"))).alias("lines"))


def runs(df: DataFrame, number: str, *keys: str) -> DataFrame:
    """Run-length encoding: (keys, first, last) of maximal runs of consecutive distinct numbers."""
    d = df.select(*keys, number).distinct()
    island = F.col(number) - F.row_number().over(Window.partitionBy(*keys).orderBy(number))
    return d.withColumn("_island", island).groupBy(*keys, "_island").agg(F.min(number).alias("first"), F.max(number).alias("last")).drop("_island")


def decoded_runs(encoded: DataFrame, number: str, *keys: str) -> DataFrame:
    return encoded.select(*keys, F.explode(F.sequence("first", "last")).alias(number))


def day_headings(df: DataFrame, time: str, order: list[str], *keys: str) -> DataFrame:
    """Adds day, and heading: whether the row opens a new local day."""
    day = S.local_time(F.col(time), "yyyy-MM-dd")
    return df.withColumn("day", day).withColumn("heading", ~F.col("day").eqNullSafe(F.lag("day").over(Window.partitionBy(*keys).orderBy(*order))))


def distinct_neighbours(df: DataFrame, digest: str, order: list[str], *keys: str) -> DataFrame:
    """Drops rows equal to the one before."""
    return df.withColumn("_l", F.lag(digest).over(Window.partitionBy(*keys).orderBy(*order))).where(~F.col(digest).eqNullSafe(F.col("_l")) | F.col("_l").isNull()).drop("_l")


def even_sample(df: DataFrame, k: int, order: list[str], *keys: str) -> DataFrame:
    """k rows at even distances, both ends among them; positions round half to even."""
    w = Window.partitionBy(*keys)
    r = df.withColumn("_rn", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    if k <= 1:
        return r.where("_rn = 0").drop("_rn", "_n")
    picks = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / F.lit(k - 1)).cast("int"))
    return r.where((F.col("_n") <= k) | F.array_contains(picks, F.col("_rn"))).drop("_rn", "_n")


def within_bytes(df: DataFrame, text: str, order: list[Column], budget: int, rows: int = 80) -> DataFrame:
    """The longest tail of at most ``rows`` rows whose texts fit the budget."""
    tail = df.orderBy(*[c.desc() for c in order]).limit(rows)
    used = F.sum(F.octet_length(text)).over(Window.orderBy(*[c.desc() for c in order]).rowsBetween(Window.unboundedPreceding, 0))
    return tail.withColumn("used_bytes", used).where(F.col("used_bytes") <= budget)


def conversation_lines(messages: DataFrame, time: str, order: list[str]) -> DataFrame:
    """(n, line): markdown of a bounded page: a heading per day, then clock, speaker and text, and the quote if any."""
    m = day_headings(messages, time, order)
    clock = F.coalesce(S.local_time(F.col(time), "HH:mm"), F.lit("--:--"))
    quote = S.quote_line(F.coalesce("quoted_sender", F.lit("")), F.col("quoted_content")) if "quoted_content" in messages.columns else F.lit(None).cast("string")
    line = F.concat_ws("\n", F.when(F.col("heading"), F.concat(F.lit("## "), F.coalesce("day", F.lit("?")))), F.concat(clock, F.lit(" "), F.col("sender_display"), F.lit("：")), quote, S.compact_text(F.col("content"), F.lit("（无可读内容）")))
    return m.select(F.row_number().over(Window.orderBy(*order)).alias("n"), line.alias("line"))


def markdown(lines: DataFrame) -> DataFrame:
    """The document of numbered lines; for pages, whose size is bounded."""
    return lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda s: s["line"]), "\n\n").alias("markdown"))


def html_page(lines: DataFrame, title: str) -> DataFrame:
    body = markdown(lines.withColumn("line", F.concat(F.lit('<article id="m'), F.col("n").cast("string"), F.lit('"><pre>'), S.html_escape(F.col("line")), F.lit("</pre></article>"))))
    return body.select(F.concat(F.lit("<!doctype html><meta charset=utf-8><title>"), S.html_escape(F.lit(title)), F.lit("</title>\n"), F.col("markdown")).alias("html"))


class Transaction:
    """Publishes a folder at once: staged, verified, then two renames; ``recover`` finishes or undoes what a crash left.

    For archives on a file system with atomic renames; larger tables belong to Spark's own committers.
    """

    def __init__(self, target: str):
        self.target = Path(target)
        self.root = self.target.parent / f".{self.target.name}.transaction"

    def publish(self, write: Callable[[str], None], check: Callable[[str], bool] = lambda _: True) -> None:
        if self.root.exists():
            raise RuntimeError("transaction_pending")
        stage, old = self.root / "stage", self.root / "old"
        stage.mkdir(parents=True)
        try:
            write(str(stage))
            if not check(str(stage)):
                raise RuntimeError("stage_verification_failed")
            (self.root / "ready").write_text(uuid.uuid4().hex)
            if self.target.exists():
                os.rename(self.target, old)
            os.rename(stage, self.target)
        except BaseException:
            self.recover("rollback")
            raise
        shutil.rmtree(self.root)

    def state(self) -> str:
        if not self.root.exists():
            return "none"
        if not (self.root / "ready").exists():
            return "staging"
        return "replaced" if self.target.exists() and not (self.root / "stage").exists() else "swapping"

    def recover(self, action: str) -> str:
        """rollback: the old folder back in place; complete: the staged one, if it was ready."""
        state, old, stage = self.state(), self.root / "old", self.root / "stage"
        if state == "none":
            return state
        if action == "complete" and state in ("swapping", "replaced"):
            if stage.exists():
                if self.target.exists():
                    os.rename(self.target, old)
                os.rename(stage, self.target)
        elif old.exists():
            if self.target.exists():
                shutil.rmtree(self.target)
            os.rename(old, self.target)
        shutil.rmtree(self.root)
        return state


def write_atomic(path: str, text: str) -> None:
    tmp = f"{path}.{uuid.uuid4().hex}.tmp"
    with open(tmp, "w", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(tmp, path)


def write_json_atomic(path: str, value: object) -> None:
    write_atomic(path, json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")).replace("\u2028", "\\u2028").replace("\u2029", "\\u2029"))


def fitted(render: Callable[[int], str], limit: int, most_bytes: int) -> str:
    """Halves the number of rows until the output fits."""
    while True:
        out = render(limit)
        if len(out.encode()) <= most_bytes or limit <= 1:
            return out
        limit //= 2


def largest_archive(archives: DataFrame, key: str, size: str, path: str = "path") -> DataFrame:
    """Of each key's archives the one with most in it; of several the one whose path comes first."""
    rest = [c for c in archives.columns if c != key]
    return archives.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct((-F.col(size)).alias("_s"), F.col(path).alias("_p"))).alias("a")).select(key, "a.*")


def by_completion(candidates: DataFrame, key: str, finished: str = "finished") -> DataFrame:
    """Adds ``nth``: the place of each candidate of a key in the order in which they finished; unfinished ones have none."""
    done = F.col(finished).isNotNull()
    w = Window.partitionBy(key, done).orderBy(F.col(finished))
    return candidates.withColumn("nth", F.when(done, F.row_number().over(w)))


def write_jsonl(rows: DataFrame, target: str) -> None:
    """Writes JSON lines as a folder that appears whole: the parts go to a folder of another name, which then takes its own.

    An older folder of that name is replaced; a write that fails leaves it as it was.
    """
    store = Store(rows.sparkSession, target.rstrip("/").rsplit("/", 1)[0])
    name = target.rstrip("/").rsplit("/", 1)[1]
    draft = f"_{name}-{uuid.uuid4().hex}"
    try:
        rows.select(S.canonical_json(*rows.columns).alias("value")).write.text(f"{store.root}/{draft}")
        if store.exists(name):
            store.delete(name)
        if not store.move(draft, name):
            raise OSError(f"{target} could not be published")
    finally:
        store.delete(draft)
