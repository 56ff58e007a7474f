"""HTTP-style APIs as a Python data source with a pluggable transport.

A transport is any picklable ``call(request) -> Response``; it owns sockets, retries,
tokens and time-outs. ``FileTransport`` answers from files and is what the tests use.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark import cloudpickle
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    DataSourceStreamWriter,
    DataSourceWriter,
    InputPartition,
    WriterCommitMessage,
)

from millrace.operators.sinks import push_params


@dataclass(frozen=True)
class Request:
    url: str
    method: str = "GET"
    headers: Mapping[str, str] = field(default_factory=dict)
    body: str | None = None


@dataclass(frozen=True)
class Response:
    status: int
    body: str

    @property
    def ok(self) -> bool:
        return 200 <= self.status < 300


Transport = Callable[[Request], Response]


@dataclass(frozen=True)
class FileTransport:
    """Answers a request from ``root`` by the quoted URL; a missing file is a 404."""

    root: str

    def __call__(self, request: Request) -> Response:
        import os
        from urllib.parse import quote

        path = os.path.join(self.root, quote(f"{request.method} {request.url}", safe=""))
        if not os.path.exists(path):
            return Response(404, "")
        with open(path, encoding="utf-8") as source:
            return Response(200, source.read())


def fill(text: str | None, variables: Mapping[str, str], braces: bool = True) -> str | None:
    """Put variables in for ``${v}`` and, for single calls, ``{{v}}``."""
    if text is None:
        return None
    for name, value in variables.items():
        text = text.replace("${" + name + "}", value)
        if braces:
            text = text.replace("{{" + name + "}}", value)
    return text


def authorised(request: Request, kind: str, config: Mapping[str, str]) -> Request:
    """Add NONE / BASIC / BEARER / API_KEY credentials to a request."""
    kind = (kind or "NONE").upper()
    headers, url = dict(request.headers), request.url
    if kind == "BASIC":
        pair = f"{config.get('username', '')}:{config.get('password', '')}"
        headers["Authorization"] = "Basic " + base64.b64encode(pair.encode()).decode()
    elif kind == "BEARER":
        headers["Authorization"] = f"Bearer {config.get('token', '')}"
    elif kind == "API_KEY":
        name, value = config.get("key", ""), config.get("value", "")
        if config.get("location", "header") == "header":
            headers[name] = value
        else:
            url += ("&" if "?" in url else "?") + f"{name}={value}"
    return Request(url, request.method, headers, request.body)


def at_path(document, path: str):
    for step in path.split("."):
        if not isinstance(document, dict):
            return None
        document = document.get(step)
    return document


@dataclass(frozen=True)
class ChainResult:
    ok: bool
    variables: dict[str, str]
    last_body: str | None
    error: str | None = None


def run_chain(transport: Transport, steps: Sequence[Mapping], variables: Mapping[str, str] | None = None
              ) -> ChainResult:
    """Ordered calls in which a step's extracted variables feed the later ones.

    For login-then-fetch: a handful of calls on the driver. A call per row is a join.
    The first answer outside 2xx stops the chain; bodies are never cut.
    """
    known = dict(variables or {})
    body: str | None = None
    for number, step in enumerate(steps, 1):
        headers = {k: fill(str(v), known, False) for k, v in (step.get("headers") or {}).items()}
        method = step.get("method") or "GET"
        sends = method.upper() in ("POST", "PUT")
        answer = transport(Request(fill(step["url"], known, False), method, headers,
                                   fill(step.get("body"), known, False) if sends else None))
        body = answer.body
        known.update(_extracted(body, step.get("extract") or {}))
        if not answer.ok:
            name = step.get("name") or f"step {number}"
            return ChainResult(False, known, body, f"{name} failed: HTTP {answer.status}")
    return ChainResult(True, known, body)


def _extracted(body: str, wanted: Mapping[str, str]) -> dict[str, str]:
    if not wanted or not body:
        return {}
    try:
        document = json.loads(body)
    except ValueError:
        return {name: body for name in wanted}
    found = {name: at_path(document, path) for name, path in wanted.items()}
    return {name: _as_text(value) for name, value in found.items() if value is not None}


def _as_text(value) -> str:
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


#: Tasks of a read that does not say how many calls each makes, at most.
MOST_TASKS = 1000


class CallRange(InputPartition):
    """Calls of one partition."""

    def __init__(self, first: int, last: int):
        super().__init__((first, last))
        self.first, self.last = first, last


class RestReader(DataSourceReader):
    """One row ``(page, status, body)`` per call; rows are made of bodies by response operators."""

    def __init__(self, options: Mapping[str, str]):
        self.transport: Transport = cloudpickle.loads(base64.b64decode(options["transport"]))
        self.url = options["url"]
        self.method = options.get("method", "GET")
        self.headers = json.loads(options.get("headers", "{}"))
        self.body = options.get("body")
        self.auth = options.get("auth", "NONE")
        self.auth_config = json.loads(options.get("authconfig", "{}"))
        self.variables = json.loads(options.get("variables", "{}"))
        self.paging = options.get("paging", "none")
        self.size = int(options.get("pagesize", "100"))
        self.total_path = options.get("totalpath", "count")
        self.items_path = options.get("itemspath", "")
        self.per_task = int(options.get("callspertask", "0"))
        self.first_page = int(options.get("firstpage", "1"))

    def call(self, extra: Mapping[str, str]) -> Response:
        url = fill(self.url, {**self.variables, **extra})
        answer = self.transport(authorised(Request(url, self.method, self.headers, self.body),
                                           self.auth, self.auth_config))
        if not answer.ok:
            raise RuntimeError(f"HTTP {answer.status} from {self.method} call")
        return answer

    def page(self, number: int) -> Response:
        return self.call({"page": str(number + self.first_page), "offset": str(number * self.size),
                          "size": str(self.size)})

    def items(self, number: int) -> list:
        """The items of a page; a body without a list has none."""
        document = json.loads(self.page(number).body)
        items = at_path(document, self.items_path) if self.items_path else document
        return items if isinstance(items, list) else []

    def is_short(self, number: int) -> bool:
        """A page with fewer items than the page size: the last one, or one past the end."""
        return len(self.items(number)) < self.size

    def call_count(self) -> int:
        """``offset``: from the total in page 1. ``page``: the first short page, found by
        doubling and halving, so that a long list costs a few probes and no task walks it alone.
        """
        if self.paging == "none":
            return 1
        if self.paging == "offset":
            total = at_path(json.loads(self.page(0).body), self.total_path)
            return max(1, -(-int(total) // self.size))
        last = self.first_short()
        # A list that fills its last page ends with an empty one, which has no rows to give.
        return last + 1 if last == 0 or self.items(last) else last

    def first_short(self, start: int = 0) -> int:
        """The first short page from ``start`` on, all pages before which are full."""
        full, short = start - 1, start
        while not self.is_short(short):
            full, short = short, 2 * short - start + 1
        while short - full > 1:
            probe = (full + short) // 2
            full, short = (full, probe) if self.is_short(probe) else (probe, short)
        return short

    def step(self, calls: int) -> int:
        """Calls of one task: as asked, else ten, or more where that would make too many tasks."""
        return self.per_task or max(10, -(-calls // MOST_TASKS))

    def partitions(self) -> Sequence[InputPartition]:
        calls = self.call_count()
        step = self.step(calls)
        return [CallRange(low, min(low + step, calls) - 1) for low in range(0, calls, step)]

    def read(self, partition: CallRange) -> Iterator[tuple]:
        for number in range(partition.first, partition.last + 1):
            answer = self.call({}) if self.paging == "none" else self.page(number)
            yield number, answer.status, answer.body


class ItemRange(InputPartition):
    """Pages of one task, and the positions of the items that the batch takes from them."""

    def __init__(self, first: int, last: int, start: int, end: int):
        super().__init__((first, last, start, end))
        self.first, self.last, self.start, self.end = first, last, start, end


class RestStreamReader(DataSourceStreamReader):
    """One row ``(position, page, item)`` per item of a paged list that grows at its end.

    The offset is the number of items read, so the checkpoint is the bookmark: a run that finds the last
    page fuller than before takes only what is new on it, and a repeated batch asks for the same items. Pages are
    counted on the driver, by the total (``offset`` paging) or by probing for the first short page
    from the one seen last; tasks fetch them. A list that lost items since it was counted fails the
    batch: nothing is skipped.
    """

    def __init__(self, options: Mapping[str, str]):
        self.calls = RestReader(options)
        if self.calls.paging not in ("page", "offset"):
            raise ValueError("a stream of items needs paging by page or offset")
        self.start_at = int(options.get("startat", "0"))
        self.seen = 0

    def initialOffset(self) -> dict:
        return {"items": self.start_at}

    def item_count(self) -> int:
        calls = self.calls
        if calls.paging == "offset":
            return int(at_path(json.loads(calls.page(0).body), calls.total_path) or 0)
        last = calls.first_short(self.seen // calls.size)
        return last * calls.size + len(calls.items(last))

    def latestOffset(self) -> dict:
        self.seen = max(self.start_at, self.item_count())
        return {"items": self.seen}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        first, last, size = start["items"], end["items"], self.calls.size
        if last < first:
            raise RuntimeError(f"the list shrank from {first} to {last} items")
        if last == first:
            return []
        pages = range(first // size, (last - 1) // size + 1)
        step = self.calls.step(len(pages))
        return [ItemRange(low, min(low + step, pages.stop) - 1, first, last) for low in pages[::step]]

    def read(self, partition: ItemRange) -> Iterator[tuple]:
        size = self.calls.size
        for number in range(partition.first, partition.last + 1):
            items, base = self.calls.items(number), number * size
            low, high = max(partition.start, base), min(partition.end, base + size)
            if len(items) < high - base:
                raise RuntimeError(f"page {number} has {len(items)} items, fewer than when it was counted")
            for position in range(low, high):
                yield position, number, json.dumps(items[position - base], ensure_ascii=False)

    def commit(self, end: dict) -> None:
        """The offset in the checkpoint is all there is to remember."""

    def stop(self) -> None:
        """Nothing is held open between calls."""


@dataclass
class Sent(WriterCommitMessage):
    """What one task sent: numbers only, so that the driver's share does not grow with the rows."""

    rows: int


class RestSender:
    """Sends rows ``(key, params)``, one call each, under an idempotency key made of write, row key and content.

    A task that Spark runs again, and a write or micro-batch that is repeated, calls with the same keys, so an API that
    honours them keeps one result per row; equal rows under one key are one. A call that fails is tried
    ``attempts`` times and then fails its task. When all tasks are done, ``commiturl`` (if given) is called
    with the number of rows; after a failure ``aborturl``.
    """

    def __init__(self, options: Mapping[str, str]):
        self.transport: Transport = cloudpickle.loads(base64.b64decode(options["transport"]))
        self.url, self.method = options["url"], options.get("method", "POST")
        self.headers = json.loads(options.get("headers", "{}"))
        self.auth, self.auth_config = options.get("auth", "NONE"), json.loads(options.get("authconfig", "{}"))
        self.attempts = int(options.get("attempts", "3"))
        self.header = options.get("idempotencyheader", "Idempotency-Key")
        self.write_id = options["writeid"]
        self.commit_url, self.abort_url = options.get("commiturl"), options.get("aborturl")

    def call(self, url: str, body: str, idempotency: str) -> None:
        request = authorised(Request(url, self.method, {**self.headers, self.header: idempotency}, body), self.auth, self.auth_config)
        for attempt in range(1, self.attempts + 1):
            try:
                answer = self.transport(request)
                if answer.ok:
                    return
                problem = RuntimeError(f"HTTP {answer.status} from {self.method} call")
            except Exception as failure:
                problem = failure
            if attempt == self.attempts:
                raise problem

    def send(self, rows: Iterator) -> Sent:
        count = 0
        for key, params in rows:
            digest = hashlib.sha256("\0".join([self.write_id, key or "", params]).encode()).hexdigest()
            self.call(fill(self.url, json.loads(params)), params, digest)
            count += 1
        return Sent(count)

    def close(self, url: str | None, label: str, messages: Sequence[Sent | None]) -> None:
        if url:
            rows = sum(m.rows for m in messages if m is not None)
            self.call(url, json.dumps({"write": label, "rows": rows}), f"{label}:{'commit' if url == self.commit_url else 'abort'}")


class RestWriter(DataSourceWriter):
    def __init__(self, options: Mapping[str, str]):
        self.sender = RestSender(options)

    def write(self, iterator: Iterator) -> Sent:
        return self.sender.send(iterator)

    def commit(self, messages: Sequence[Sent | None]) -> None:
        self.sender.close(self.sender.commit_url, self.sender.write_id, messages)

    def abort(self, messages: Sequence[Sent | None]) -> None:
        self.sender.close(self.sender.abort_url, self.sender.write_id, messages)


class RestStreamWriter(DataSourceStreamWriter):
    """The same for micro-batches; commit and abort name the batch."""

    def __init__(self, options: Mapping[str, str]):
        self.sender = RestSender(options)

    def write(self, iterator: Iterator) -> Sent:
        return self.sender.send(iterator)

    def commit(self, messages: Sequence[Sent | None], batchId: int) -> None:
        self.sender.close(self.sender.commit_url, f"{self.sender.write_id}/{batchId}", messages)

    def abort(self, messages: Sequence[Sent | None], batchId: int) -> None:
        self.sender.close(self.sender.abort_url, f"{self.sender.write_id}/{batchId}", messages)


class RestSource(DataSource):
    """Calls of an API: a batch of answers, a stream of items, or an output that makes a call per row."""

    @classmethod
    def name(cls) -> str:
        return "rest"

    def schema(self) -> str:
        if self.options.get("rows") == "items":
            return "position bigint, page bigint, item string"
        return "page int, status int, body string"

    def reader(self, schema) -> DataSourceReader:
        return RestReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return RestStreamReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return RestWriter(self.options)

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return RestStreamWriter(self.options)


def packed(transport: Transport) -> str:
    return base64.b64encode(cloudpickle.dumps(transport)).decode()


def read(spark: SparkSession, transport: Transport, url: str, **options: str) -> DataFrame:
    """Call an API; see ``RestReader`` for paging, auth and variables options."""
    spark.dataSource.register(RestSource)
    texts = {k: v if isinstance(v, str) else json.dumps(v) for k, v in options.items()}
    return spark.read.format("rest").options(transport=packed(transport), url=url, **texts).load()


def read_stream(spark: SparkSession, transport: Transport, url: str, **options: str) -> DataFrame:
    """Items of a paged list as they are added; see ``RestStreamReader``."""
    spark.dataSource.register(RestSource)
    texts = {k: v if isinstance(v, str) else json.dumps(v) for k, v in options.items()}
    return spark.readStream.format("rest").options(transport=packed(transport), url=url, rows="items", **texts).load()


def _sending(df: DataFrame, transport: Transport, key: str, url: str, write_id: str, options: Mapping) -> tuple[DataFrame, dict]:
    df.sparkSession.dataSource.register(RestSource)
    rows = df.select(F.col(f"`{key}`").cast("string").alias("key"), F.to_json(push_params(df)).alias("params"))
    texts = {k: v if isinstance(v, str) else json.dumps(v) for k, v in options.items()}
    return rows, dict(transport=packed(transport), url=url, writeid=write_id, **texts)


def write(df: DataFrame, transport: Transport, key: str, url: str, write_id: str, tries: int = 2, **options: str) -> None:
    """One call per row, all or fail; see ``RestSender``. A write that failed is repeated under the same keys."""
    rows, texts = _sending(df, transport, key, url, write_id, options)
    for left in reversed(range(tries)):
        try:
            rows.write.format("rest").options(**texts).mode("append").save()
            return
        except (PySparkException, Py4JJavaError):
            if not left:
                raise


def write_stream(stream: DataFrame, transport: Transport, key: str, url: str, write_id: str, checkpoint: str, **options: str) -> None:
    """The same for what has arrived on a stream since the last call."""
    rows, texts = _sending(stream, transport, key, url, write_id, options)
    (rows.writeStream.format("rest").options(**texts).option("checkpointLocation", checkpoint).trigger(availableNow=True)
     .start().awaitTermination())


def push(df: DataFrame, transport: Transport, key: str, url: str, method: str = "POST",
         headers: Mapping[str, str] | None = None, auth: str = "NONE",
         auth_config: Mapping[str, str] | None = None) -> DataFrame:
    """One call per row; gives ``(key, ok, status, error)``. At least once: a retried task calls again."""
    packed_call = cloudpickle.dumps((transport, authorised, fill, Request))
    rows = df.select(F.col(key).cast("string").alias("key"), F.to_json(push_params(df)).alias("params"))
    settings = (url, method, dict(headers or {}), auth, dict(auth_config or {}))

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call, sign, put_in, make = cloudpickle.loads(packed_call)
        to, how, heads, kind, config = settings
        for batch in batches:
            results = []
            for row_key, params in zip(batch["key"], batch["params"]):
                try:
                    answer = call(sign(make(put_in(to, json.loads(params)), how, heads, params),
                                       kind, config))
                    results.append((row_key, answer.ok, answer.status,
                                    None if answer.ok else f"HTTP {answer.status}"))
                except Exception as problem:
                    results.append((row_key, False, None, f"{type(problem).__name__}: {problem}"))
            frame = pd.DataFrame(results, columns=["key", "ok", "status", "error"])
            frame["status"] = frame["status"].astype("Int32")
            yield frame

    return rows.mapInPandas(send, schema="key string, ok boolean, status int, error string")
