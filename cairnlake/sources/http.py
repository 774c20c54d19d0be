"""Chunk stores behind HTTP: one request per chunk, made by the tasks that hold the ids.

GET: 404 and 410 mean missing, an empty body is an error, the body is the plain payload and is hashed by default. Presence is asked
by HEAD, and by GET where HEAD isn't allowed (405, 501). PUT or POST: what exists can be skipped; 409 means it does.
"""

from __future__ import annotations

import dataclasses
import urllib.error
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_streams
from .retry import RemoteError, RetryPolicy, kind_of_status, with_retries
from .sigv4 import Credentials, sign
from .templates import Template, header


@dataclasses.dataclass(frozen=True)
class Endpoint:
    base: str
    url: str = "{base}/{path}"
    headers: tuple[str, ...] = ()
    policy: RetryPolicy = RetryPolicy()
    timeout: float = 30.0
    algorithm: str = "sha256"
    verify: bool = True
    credentials: Credentials | None = None
    region: str = "us-east-1"

    def __post_init__(self) -> None:
        Template(self.url)
        names = [header(h)[0].lower() for h in self.headers]
        for h in self.headers:
            Template(header(h)[1])
        if self.credentials and "authorization" in names:
            raise ValueError("signed requests can't have an Authorization header")

    def _request(self, method: str, chunk_id: str, data: bytes | None = None) -> tuple[int, bytes]:
        url = Template(self.url)(self.base, chunk_id)
        headers = {k: Template(v)(self.base, chunk_id) for k, v in map(header, self.headers)}
        if self.credentials:
            headers = sign(method, url, headers, data or b"", self.credentials, self.region)
        try:
            with urllib.request.urlopen(urllib.request.Request(url, data, headers, method=method), timeout=self.timeout) as r:
                return r.status, r.read() if method != "HEAD" else b""
        except urllib.error.HTTPError as e:
            return e.code, b""
        except OSError as e:
            raise RemoteError(f"{method} {url}: {e}", "transient") from e

    def _checked(self, method: str, chunk_id: str, data: bytes | None = None, fine: tuple[int, ...] = ()) -> tuple[int, bytes]:
        code, body = self._request(method, chunk_id, data)
        kind = None if code in fine else kind_of_status(code)
        if kind:
            raise RemoteError(f"{method} {chunk_id}: HTTP {code}", kind)
        return code, body

    def get(self, chunk_id: str) -> tuple[bytes, int]:
        """(payload, retries)."""

        def once() -> bytes:
            _, body = self._checked("GET", chunk_id)
            if not body:
                raise RemoteError(f"GET {chunk_id}: empty body", "permanent")
            if self.verify and hash_streams(iter([body]), self.algorithm) != chunk_id:
                raise RemoteError(f"GET {chunk_id}: wrong content", "corrupt")
            return body

        return with_retries(once, self.policy)

    def has(self, chunk_id: str) -> bool:
        def once() -> bool:
            code, _ = self._checked("HEAD", chunk_id, fine=(404, 410, 405, 501))
            if code in (405, 501):
                code, _ = self._checked("GET", chunk_id, fine=(404, 410))
            return code not in (404, 410)

        return with_retries(once, self.policy)[0]

    def put(self, chunk_id: str, payload: bytes, method: str = "PUT", skip_if_exists: bool = True) -> tuple[str, int]:
        """(uploaded or skipped, retries)."""
        if self.verify and hash_streams(iter([payload]), self.algorithm) != chunk_id:
            raise RemoteError(f"{method} {chunk_id}: payload has another id", "permanent")
        if skip_if_exists and self.has(chunk_id):
            return "skipped", 0
        (code, _), retries = with_retries(lambda: self._checked(method, chunk_id, payload, fine=(409,)), self.policy)
        return "skipped" if code == 409 else "uploaded", retries

    def reachable(self) -> bool:
        """Whether anything answers at the base, with any status."""
        for method in ("HEAD", "GET"):
            try:
                with urllib.request.urlopen(urllib.request.Request(self.base, method=method), timeout=self.timeout):
                    return True
            except urllib.error.HTTPError as e:
                if method == "GET" or e.code not in (405, 501):
                    return True
            except OSError:
                return False
        return False


_OUT = pa.schema([("chunk_id", pa.string()), ("payload", pa.binary()), ("outcome", pa.string()), ("retries", pa.int64())])


def fetch(ids: DataFrame, endpoint: Endpoint) -> DataFrame:
    """(chunk_id, payload, outcome: fetched, missing, failed_transient or failed_permanent, retries) of each id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk_id in b.column("chunk_id").to_pylist():
                row = {"chunk_id": chunk_id, "payload": None, "retries": 0}
                try:
                    row["payload"], row["retries"] = endpoint.get(chunk_id)
                    row["outcome"] = "fetched"
                except RemoteError as e:
                    row["outcome"] = "missing" if e.kind == "missing" else "failed_transient" if e.kind == "transient" else "failed_permanent"
                yield pa.RecordBatch.from_pylist([row], schema=_OUT)  # a batch per chunk: memory holds one payload

    return ids.select("chunk_id").distinct().mapInArrow(run, "chunk_id string, payload binary, outcome string, retries long")


def present(ids: DataFrame, endpoint: Endpoint) -> DataFrame:
    """(chunk_id, present) of each id, asked one by one; a failure that isn't absence raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("chunk_id").to_pylist()
            yield pa.RecordBatch.from_pydict({"chunk_id": ids, "present": [endpoint.has(x) for x in ids]}, schema=pa.schema([("chunk_id", pa.string()), ("present", pa.bool_())]))

    return ids.select("chunk_id").distinct().mapInArrow(run, "chunk_id string, present boolean")


def upload(chunks: DataFrame, endpoint: Endpoint, method: str = "PUT", skip_if_exists: bool = True) -> DataFrame:
    """(chunk_id, outcome: uploaded, skipped, failed_transient or failed_permanent, retries) of each (chunk_id, payload)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for chunk_id, payload in zip(b.column("chunk_id").to_pylist(), b.column("payload"), strict=True):
                try:
                    outcome, retries = endpoint.put(chunk_id, payload.as_py(), method, skip_if_exists)
                except RemoteError as e:
                    outcome, retries = "failed_transient" if e.kind == "transient" else "failed_permanent", 0
                rows.append({"chunk_id": chunk_id, "outcome": outcome, "retries": retries})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([_OUT.field("chunk_id"), _OUT.field("outcome"), _OUT.field("retries")]))

    one = chunks.groupBy("chunk_id").agg(F.first("payload").alias("payload"))
    return one.mapInArrow(run, "chunk_id string, outcome string, retries long")
