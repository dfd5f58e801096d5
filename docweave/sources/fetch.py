"""Pages over HTTP, as a batched operator with a replaceable transport; nothing is fetched unless it is asked for."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .files import decode

#: Defaults: seconds to wait, tries after the first, seconds between them, bytes at most.
TIMEOUT, RETRIES, WAIT, MAX_BYTES = 15.0, 2, 2.0, 20 * 1024 * 1024
# Answers worth another try.
TRANSIENT = frozenset((408, 429, 500, 502, 503, 504))
Transport = Callable[[str, float, int], tuple[int, str, str, bytes]]
SCHEMA = "url string, url_final string, status int, content_type string, encoding string, html string, digest string, error string"


def http_get(url: str, timeout: float, limit: int) -> tuple[int, str, str, bytes]:
    """(status, final address, content type, bytes)."""
    from urllib.request import Request, urlopen

    with urlopen(Request(url, headers={"User-Agent": "docweave", "Accept": "text/html,*/*"}), timeout=timeout) as r:
        return r.status, r.url, r.headers.get("Content-Type", ""), r.read(limit + 1)


def fetch_one(url: str, get: Transport, timeout: float = TIMEOUT, retries: int = RETRIES, wait: float = WAIT, limit: int = MAX_BYTES) -> dict:
    error = ""
    for k in range(retries + 1):
        if k and wait:
            time.sleep(wait * k)
        try:
            status, final, kind, raw = get(url, timeout, limit)
        except Exception as e:  # the row carries the error
            error, code = str(e) or type(e).__name__, getattr(e, "code", None)
            if isinstance(e, TimeoutError) or code in TRANSIENT:
                continue
            break
        if status in TRANSIENT and k < retries:
            error = f"status {status}"
            continue
        if len(raw) > limit:
            return {"url": url, "error": f"more than {limit} bytes"}
        html, enc = decode(raw, kind)
        return {"url": url, "url_final": final, "status": status, "content_type": kind, "encoding": enc, "html": html, "digest": hashlib.sha256(raw).hexdigest(), "error": ""}
    return {"url": url, "error": error}


def fetched(urls: DataFrame, transport: Transport = http_get, pause: float = 1.0, **options) -> DataFrame:  # noqa: ANN003
    """A row per address (url): the answer, or the error of the last try; a failure stops nothing."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for b in batches:
            rows = []
            for u in b.column("url").to_pylist():
                if not first and pause:
                    time.sleep(pause)
                first = False
                rows.append(fetch_one(u, transport, **options) if u else {"url": u, "error": "no address"})
            yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], pa.int32() if c == "status" else pa.string()) for c in names], names=names)

    return urls.select("url").mapInArrow(run, SCHEMA)
