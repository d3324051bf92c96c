"""A Spark data source for a vendor's ad search: continuation tokens, retries, and offsets to resume from.

A request asks for the ads of one domain. Its answers come in pages, each of which names the
token of the next; a page that can't be had is asked for again after a pause that
doubles each time. ``spark.read.format("ad_search")`` reads all requests that there
are, ``spark.readStream`` those that come, in the order of their numbers: the
number of the last one read is the offset, so that a stream that was cut off goes on
after the last batch that it finished, and a file sink holds each answer once.

Options: ``path`` (where the client finds requests and answers), ``client`` (``module:Class``
with ``requests()`` and ``fetch(request, token, attempt)``, RecordedSearch if left out; one with ``parts()`` and ``requests_of(part)``
has its requests read part by part, without a list of them in the driver), ``retries``
(3), ``backoffMs`` (500), ``maxPages`` (20), ``perPartition`` and ``perBatch`` (requests, 16 and 256).

Rows: ``request``, ``domain``, ``page`` (from 0), ``outcome`` (OK; UNAVAILABLE with a ``reason``, after which nothing of the request follows; CUT
where there would be more than ``maxPages``), ``attempts`` and ``body``.
"""

from __future__ import annotations

import importlib
import io
import json
import time
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "request long, domain string, page int, outcome string, reason string, attempts int, body string"


class RecordedSearch:
    """Answers from a folder: ``request=<number>-<domain>/page=<token>/`` with one text file, a JSON list of what each attempt gets (``status`` and perhaps ``body``, a JSON text with ``next``)."""

    def __init__(self, path: str):
        self.store, self.root = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")

    def requests(self) -> list[tuple[int, str]]:
        names = [f.base_name for f in self.store.get_file_info(fs.FileSelector(self.root, allow_not_found=True)) if f.base_name.startswith("request=")]
        return sorted((int(number), domain) for number, _, domain in (n.removeprefix("request=").partition("-") for n in names))

    def fetch(self, request: tuple[int, str], token: str, attempt: int) -> tuple[int, str | None]:
        """Status and body of one attempt, the first being 0."""
        folder = f"{self.root}/request={request[0]}-{request[1]}/page={token}"
        files = [f for f in self.store.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if f.is_file and not f.base_name.startswith((".", "_"))]
        if not files:
            return 404, None
        with self.store.open_input_stream(files[0].path) as stream:
            told = json.loads(stream.read().decode("utf-8"))
        answer = told[min(attempt, len(told) - 1)]
        return answer["status"], answer.get("body")


class FiledSearch:
    """Answers from a folder of files of lines, one for each request: JSON with ``request``, ``domain`` and ``pages``, which gives for each token the list of what its attempts get (as in RecordedSearch).

    A file is a part: it is read line by line, and only one request's answers are held.
    """

    def __init__(self, path: str):
        self.store, self.root = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        self.asked, self.pages = None, {}

    def parts(self) -> list[str]:
        files = self.store.get_file_info(fs.FileSelector(self.root, allow_not_found=True))
        return sorted(f.path for f in files if f.is_file and f.size and not f.base_name.startswith((".", "_")))

    def requests_of(self, part: str) -> Iterator[tuple[int, str]]:
        with self.store.open_input_stream(part) as stream:
            for line in io.TextIOWrapper(stream, encoding="utf-8", newline="\n"):
                told = json.loads(line)
                self.asked, self.pages = (told["request"], told["domain"]), told["pages"]
                yield self.asked

    def fetch(self, request: tuple[int, str], token: str, attempt: int) -> tuple[int, str | None]:
        """Status and body of one attempt at the request that was read last."""
        told = self.pages.get(token) if request == self.asked else None
        if not told:
            return 404, None
        answer = told[min(attempt, len(told) - 1)]
        return answer["status"], answer.get("body")


class AdSearch(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ad_search"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(dict(self.options))


class _Asks:
    def __init__(self, options: dict[str, str]):
        lower = {k.lower(): v for k, v in options.items()}
        number = lambda name, usual: int(lower.get(name.lower(), usual))
        self.path, self.client = lower["path"], lower.get("client", f"{__name__}:RecordedSearch")
        self.retries, self.backoff, self.pages = number("retries", 3), number("backoffMs", 500) / 1000, number("maxPages", 20)
        self.together, self.batch = number("perPartition", 16), number("perBatch", 256)

    def _client(self):
        module, _, name = self.client.partition(":")
        return getattr(importlib.import_module(module), name)(self.path)

    def _parts(self, requests: list[tuple[int, str]]) -> list[InputPartition]:
        return [InputPartition(requests[at : at + self.together]) for at in range(0, len(requests), self.together)]

    def _answer(self, client, request: tuple[int, str], token: str) -> tuple[int, int, str | None]:
        """Status, attempts and body, after as many retries as it takes; what the vendor refuses for good isn't asked for again."""
        status, body = 0, None
        for attempt in range(self.retries + 1):
            if attempt:
                time.sleep(self.backoff * 2 ** (attempt - 1))
            try:
                status, body = client.fetch(request, token, attempt)
            except OSError:
                status, body = 0, None
            if status == 200 or 400 <= status < 500 and status != 429:
                break
        return status, attempt + 1, body

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        client = self._client()
        asked = partition.value if partition else ()  # None where there are no partitions
        for request in client.requests_of(asked) if isinstance(asked, str) else asked:
            request, token = tuple(request), "first"
            for page in range(self.pages):
                status, attempts, body = self._answer(client, request, token)
                try:
                    following = json.loads(body).get("next") if status == 200 else None
                except (TypeError, ValueError, AttributeError):
                    status = -1
                if status != 200:
                    reason = "unreadable answer" if status < 0 else "no answer" if not status else f"status {status}"
                    yield (*request, page, "UNAVAILABLE", reason, attempts, None)
                    break
                cut = bool(following) and page == self.pages - 1
                yield (*request, page, "CUT" if cut else "OK", None, attempts, body)
                if not following:
                    break
                token = following


class _Batch(_Asks, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        client = self._client()
        return [InputPartition(p) for p in client.parts()] if hasattr(client, "parts") else self._parts(client.requests())


class _Stream(_Asks, DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.last: int | None = None

    def initialOffset(self) -> dict:
        return {"request": -1}

    def latestOffset(self) -> dict:
        """Some requests beyond the last offset at a time; the driver asks again until there are none."""
        known = [n for n, _ in self._client().requests() if self.last is None or n > self.last]
        if known:
            self.last = known[min(self.batch, len(known)) - 1]
        return {"request": -1 if self.last is None else self.last}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.last = max(end["request"], -1 if self.last is None else self.last)  # after a restart
        return self._parts([r for r in self._client().requests() if start["request"] < r[0] <= end["request"]])

    def commit(self, end: dict) -> None:
        pass
