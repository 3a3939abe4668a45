"""A feed behind an injected transport: codes, one series' raw response, and a loop that lands responses and can be resumed.

The transport is any object with `codes()` (a mapping or iterable of codes) and `history(code)` (a raw response, or None where the feed
answers but has nothing). It alone touches a network; this module adds what must hold around it.
"""

from __future__ import annotations

import gzip
import json
import os
import threading
import time
from collections.abc import Callable, Iterable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources import ingest

LEAST_CODES = 10_000
TIMEOUT = (5.0, 30.0)
BACK_OFF = (2.0, 8.0, 32.0)


class Transport(Protocol):
    def codes(self) -> Iterable[str]: ...

    def history(self, code: str) -> dict | None: ...


_lock = threading.Lock()
_client: Transport | None = None


def client(connect: Callable[..., Transport], least_codes: int = LEAST_CODES, timeout: tuple[float, float] = TIMEOUT) -> Transport:
    """One client per process, made once with the timeouts to connect and to read; a feed that lists too few codes is refused."""
    global _client
    with _lock:
        if _client is None:
            made = connect(timeout=timeout)
            if (n := len(list(made.codes()))) < least_codes:
                raise ValueError(f"the feed lists {n} codes, fewer than {least_codes}")
            _client = made
        return _client


def list_codes(feed: Transport) -> list[str]:
    """The numeric codes, distinct and sorted."""
    return sorted({c.strip() for c in feed.codes() if c.strip().isdigit()})


def fetch(feed: Transport, code: str) -> dict | None:
    """One raw response; None only where the feed answers with nothing, faults go through."""
    found = feed.history(code)
    return found if found and found.get("data") else None


def history(spark: SparkSession, feed: Transport, code: str) -> DataFrame:
    """The levels of one series; no data raises."""
    raw = fetch(feed, code)
    if raw is None:
        raise ValueError(f"no data for {code}")
    return ingest.normalise(spark.createDataFrame([(code, [(x["date"], x["nav"]) for x in raw["data"]])], "scheme_code string, data array<struct<date: string, nav: string>>"))


def shard_path(folder: str, code: str) -> str:
    return os.path.join(folder, "raw", f"{code}.json.gz")


def write_shard(path: str, raw: dict) -> None:
    """A whole file or none: written beside its name and moved there."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with gzip.open(f"{path}.part", "wt", encoding="utf-8") as f:
        json.dump(raw, f)
    os.replace(f"{path}.part", path)


def land_feed(feed: Transport, folder: str, delay: float = 0.75, most_retries: int = 3, shard: tuple[int, int] | None = None, retry_failed: bool = False, sleep: Callable[[float], None] = time.sleep) -> dict[str, int]:
    """Fetch what is neither landed nor failed into one file per code; counts of landed, skipped and failed ones.

    `shard` (i, n) takes every n-th code from the i-th on. A fault is tried again after growing pauses; an empty answer once more. What
    still fails is appended, with its reason, to failed.tsv, which later runs skip unless told otherwise."""
    log = os.path.join(folder, "failed.tsv")
    failed: set[str] = set()
    if os.path.exists(log) and not retry_failed:
        with open(log, encoding="utf-8") as f:
            failed = {line.split("\t", 1)[0] for line in f if line.strip()}
    codes = list_codes(feed)
    i, n = shard or (0, 1)
    done = {"landed": 0, "skipped": 0, "failed": 0}
    for code in codes[i::n]:
        path = shard_path(folder, code)
        if code in failed or os.path.exists(path):
            done["skipped"] += 1
            continue
        raw, reason, empty = None, "", 0
        for attempt in range(most_retries + 1):
            try:
                raw, reason = fetch(feed, code), "no data"
                if raw is not None or empty:
                    break
                empty += 1
            except Exception as fault:  # noqa: BLE001  whatever a transport raises counts as a fault
                reason = f"{type(fault).__name__}: {fault}"
            if attempt < most_retries:
                sleep(BACK_OFF[min(attempt, len(BACK_OFF) - 1)])
        if raw is None:
            os.makedirs(folder, exist_ok=True)
            with open(log, "a", encoding="utf-8") as f:
                f.write(f"{code}\t{' '.join(reason.split())}\n")
            done["failed"] += 1
        else:
            write_shard(path, raw)
            done["landed"] += 1
        sleep(delay)
    return done
