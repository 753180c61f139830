"""Published packages and archives: reading packages, merged conversation archives, replaced feed snapshots, readiness."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import archive as A


def _facts(root: Path) -> list[dict]:
    """(path, size, sha256) of a package's files; packages are bounded by their page."""
    files = sorted(p for p in root.rglob("*") if p.is_file() and p.name != "manifest.json" and not p.name.endswith(".crc"))
    return [{"path": p.relative_to(root).as_posix(), "size": p.stat().st_size, "sha256": hashlib.sha256(p.read_bytes()).hexdigest()} for p in files]


def write_package(target: str, page: DataFrame, title: str, gaps: list[dict] | None = None, media: dict[str, bytes] | None = None) -> dict:
    """A reading package of a bounded page: records, markdown, HTML, media by content, a manifest of every file; published at once."""
    lines = A.conversation_lines(page, "create_time", ["create_time", "id_value"]).cache()
    rows = [json.loads(r) for r in page.orderBy("create_time", "id_value").toJSON().collect()]
    text, html = A.markdown(lines).head()["markdown"], A.html_page(lines, title).head()["html"]
    lines.unpersist()
    result = {"status": "partial" if gaps else "success", "messages": len(rows), "gaps": gaps or []}

    def write(stage: str) -> None:
        root = Path(stage)
        A.write_json_atomic(str(root / "conversation.json"), rows)
        A.write_atomic(str(root / "ai-context.md"), text or "")
        A.write_atomic(str(root / "conversation.html"), html or "")
        for name, content in (media or {}).items():
            digest = hashlib.sha256(content).hexdigest()
            place = root / "media" / digest[:2] / f"{digest}{Path(name).suffix}"
            place.parent.mkdir(parents=True, exist_ok=True)
            place.write_bytes(content)
        A.write_json_atomic(str(root / "manifest.json"), {"title": title, **result, "files": _facts(root)})

    A.Transaction(target).publish(write, lambda stage: not verify_package(stage))
    return result


def verify_package(target: str) -> list[str]:
    """Sorted error codes of declared against actual files; an unreadable manifest is one as well."""
    root = Path(target)
    try:
        declared = {f["path"]: (f["size"], f["sha256"]) for f in json.loads((root / "manifest.json").read_text())["files"]}
    except (OSError, ValueError, KeyError, TypeError):
        return ["manifest_unreadable"]
    actual = {f["path"]: (f["size"], f["sha256"]) for f in _facts(root)}
    codes = {"missing" for p in declared.keys() - actual.keys()} | {"undeclared" for p in actual.keys() - declared.keys()}
    for p in declared.keys() & actual.keys():
        if declared[p][0] != actual[p][0]:
            codes.add("size_mismatch")
        elif declared[p][1] != actual[p][1]:
            codes.add("hash_mismatch")
    return sorted(codes)


def _state(target: str) -> dict | None:
    path = Path(target) / "state.json"
    return json.loads(path.read_text()) if path.exists() else None


def _publish(target: str, records: DataFrame, state: dict) -> None:
    """Records first, the state last: it marks the archive as complete."""

    def write(stage: str) -> None:
        records.write.mode("overwrite").parquet(f"file://{Path(stage).resolve()}/records")
        A.write_json_atomic(f"{stage}/state.json", state)

    A.Transaction(target).publish(write)


def sync_archive(
    spark: SparkSession, target: str, incoming: DataFrame, *, key: str = "export_key", digest: str = "digest", time: str = "create_time", seq: str = "sort_seq",
    fingerprint: str, sources: int = 1, identity: str = "", full: bool = False, overlap: int = A.OVERLAP, refingerprint=None,
) -> dict:
    """Merges what a source holds into an archive on a shared file system; rows that the source has lost are retained.

    Nothing is read when the fingerprint is the archive's. Otherwise only rows after the watermark
    and the overlap are merged, by sequence from a single source, else by time. A source that
    changes while it is read fails the sync, before anything is published.
    """
    state = _state(target)
    mode = A.sync_mode(state, fingerprint, sources, state is not None and state.get("sources") == sources, state is None or state.get("identity") == identity, full)
    if mode == "no_change":
        return {"mode": mode, "added": 0, "updated": 0}
    fresh = incoming
    if mode == "incremental_by_sequence":
        fresh = incoming.where((F.col(seq) > state["max_seq"]) | (F.col(seq) >= state["replay_floor"]))
    elif mode == "incremental_by_time" and state["max_time"] is not None:
        fresh = incoming.where((F.col(time) >= state["max_time"] - overlap) | F.col(time).isNull())
    old = spark.read.parquet(f"file://{Path(target).resolve()}/records") if state is not None else spark.createDataFrame([], incoming.schema)
    merged = A.merged(old, fresh, key, digest)
    if mode == "sender_identity_reconcile" and {"sender_role", "sender_username"} <= set(incoming.columns):
        merged = A.downgraded(merged, fresh, key)
    merged = merged.cache()
    try:
        counts = {r["change"]: r["n"] for r in A.gap_counts(merged, "change").collect()}
        marks = A.watermarks(merged, seq, time, overlap).head()
        if refingerprint is not None and refingerprint() != fingerprint:
            raise RuntimeError("source_changed_during_sync_retry")
        new = {"fingerprint": fingerprint, "sources": sources, "identity": identity, "max_seq": marks["max_seq"], "max_time": marks["max_time"], "replay_floor": marks["replay_floor"], "records": sum(counts.values())}
        _publish(target, merged.drop("change").orderBy(F.col(time).asc_nulls_last(), F.col(seq).asc_nulls_last(), key), new)
    finally:
        merged.unpersist()
    return {"mode": mode, "added": counts.get("added", 0), "updated": counts.get("updated", 0), "same": counts.get("same", 0), "retained": counts.get("retained", 0)}


def sync_snapshot(spark: SparkSession, target: str, new: DataFrame, *, key: str, digest: str, fingerprint: str) -> dict:
    """Replaces a snapshot, with counts of new, updated, removed and same rows; evicted rows go."""
    state = _state(target)
    if state is not None and state.get("fingerprint") == fingerprint:
        return {"mode": "no_change"}
    old = spark.read.parquet(f"file://{Path(target).resolve()}/records") if state is not None else spark.createDataFrame([], new.schema)
    counts = {r["change"]: r["n"] for r in A.gap_counts(A.snapshot_diff(old, new, key, digest), "change").collect()}
    _publish(target, new, {"fingerprint": fingerprint, "records": new.count()})
    return {"mode": "replaced", **{k: counts.get(k, 0) for k in ("new", "updated", "removed", "same")}}


def write_statistics(manifests: DataFrame, target: str) -> dict:
    r = A.statistics(manifests).head().asDict()
    A.write_json_atomic(target, r | {"latest": str(r["latest"]) if r["latest"] is not None else None})
    return r


def readiness(sources: dict[str, DataFrame], required: dict[str, tuple[str, ...]]) -> dict:
    """Whether each source is there, with the columns it needs and a row at least."""
    out = {}
    for name, columns in required.items():
        df = sources.get(name)
        missing = [] if df is None else sorted(set(columns) - set(df.columns))
        out[name] = "missing" if df is None else f"columns_missing:{','.join(missing)}" if missing else "ready" if df.limit(1).count() else "empty"
    return {"status": "ready" if all(v in ("ready", "empty") for v in out.values()) else "not_ready", "sources": out}
