"""A sequential model of the rules, for comparison with the Spark results."""

from __future__ import annotations


def judge(rows, threshold=0, cap=10_000, ttl=300_000, active=("u", "o", "w")):
    """rows: dicts with lane, off, flow, ts, key, ingest (None where missing)."""
    store: dict = {}
    offsets: dict = {}
    marks: dict = {}
    verdicts = []
    for row in rows:
        failed = None
        if "u" in active and row["key"] is not None and row["key"] in store:
            failed = "uniqueness"
        elif "o" in active and row["lane"] in offsets and row["off"] <= offsets[row["lane"]]:
            failed = "offset"
        elif "w" in active and row["flow"] in marks and row["ts"] is not None:
            late = marks[row["flow"]] - row["ts"]
            if late > 0 and late > threshold:
                failed = "sender_watermark"
        verdicts.append(failed)
        if failed:
            continue
        offsets[row["lane"]] = row["off"]
        if row["flow"] is not None and row["ts"] is not None:
            marks[row["flow"]] = row["ts"]
        if row["key"] is not None:
            store.pop(row["key"], None)
            store[row["key"]] = row["ingest"]
            store = {k: t for k, t in store.items() if row["ingest"] - t <= ttl}
            while len(store) > cap:
                del store[next(iter(store))]
    return verdicts, offsets, marks, store
