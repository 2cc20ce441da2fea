"""Paged sources behind one fetch function, read in parallel by key ranges as a resumable stream.

``fetch(request)`` gives an ``Answer`` for a ``Request``: over the network, from files, or from a
table. Pages of a request follow one another by a cursor in the body, a token, or a link in the headers. A
source has a growing key (a number, a date, a sequence): its offset is how far that key has been read, a
batch covers the keys since then, and the keys of a batch are cut into ranges that tasks page through at
once. Offsets are committed by the stream's checkpoint; a batch that breaks off is read again as a
whole, so rows come at least once, and exactly once after a keyed sink.
"""

from __future__ import annotations

import json
import random
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from urllib.parse import parse_qsl, urlsplit

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StringType, StructType, _parse_datatype_string

#: Answers that are worth another try.
AGAIN = (429, 500, 502, 503, 504)


@dataclass(frozen=True)
class Request:
    """What is asked: a url with parameters, by GET or POST."""

    url: str
    params: tuple[tuple[str, str], ...] = ()
    method: str = "GET"

    def with_params(self, **more: object) -> "Request":
        return replace(self, params=tuple((dict(self.params) | {k: str(v) for k, v in more.items()}).items()))


@dataclass(frozen=True)
class Answer:
    status: int
    body: bytes = b""
    headers: dict[str, str] = field(default_factory=dict)

    def json(self) -> dict:
        return json.loads(self.body)


class FetchError(RuntimeError):
    def __init__(self, request: Request, status: int):
        super().__init__(f"{request.method} {request.url}: {status}")
        self.status = status


Fetch = Callable[[Request], Answer]


def waits(tries: int, most: float = 120.0) -> Iterator[float]:
    """1, 2, 4, … seconds, a quarter more or less."""
    for k in range(tries - 1):
        yield min(most, 2.0**k) * random.uniform(0.75, 1.25)


def with_retry(fetch: Fetch, *, tries: int = 6, most: float = 120.0, sleep: Callable[[float], None] = time.sleep, again: tuple[int, ...] = AGAIN) -> Fetch:
    """Tries once more what failed in passing (a status in ``again``, a lost connection); raises what else isn't 2xx."""

    def call(request: Request) -> Answer:
        pauses = waits(tries, most)
        while True:
            try:
                answer = fetch(request)
                if answer.status < 300:
                    return answer
                problem: Exception = FetchError(request, answer.status)
                passing = answer.status in again
            except (ConnectionError, TimeoutError) as e:
                problem, passing = e, True
            pause = next(pauses, None) if passing else None
            if pause is None:
                raise problem
            sleep(pause)

    return call


def post_after_get(fetch: Fetch) -> Fetch:
    """Asks by POST what GET is refused."""

    def call(request: Request) -> Answer:
        try:
            answer = fetch(request)
            if answer.status < 300:
                return answer
        except (FetchError, ConnectionError, TimeoutError):
            pass
        return fetch(replace(request, method="POST"))

    return call


def at_path(body: object, path: str) -> object:
    """What a dotted path leads to in parsed JSON; None where it ends."""
    for part in path.split(".") if path else []:
        body = body.get(part) if isinstance(body, dict) else None
    return body


def next_by_cursor(path: str, param: str) -> Callable[[Request, Answer], Request | None]:
    """The next page by a cursor or token in the body, until it is missing or stands still."""

    def follow(request: Request, answer: Answer) -> Request | None:
        cursor = at_path(answer.json(), path)
        return None if not cursor or str(cursor) == dict(request.params).get(param) else request.with_params(**{param: cursor})

    return follow


def next_by_link(request: Request, answer: Answer) -> Request | None:
    """The next page by a header ``Link: <…>; rel="next"``; parameters that the link leaves out stay."""
    header = next((v for k, v in answer.headers.items() if k.lower() == "link"), "")
    found = re.search(r'<([^>]+)>\s*;[^,]*rel="?next"?', header)
    if not found:
        return None
    parts = urlsplit(found[1])
    kept = dict(request.params) | dict(parse_qsl(parts.query, keep_blank_values=True))
    after = replace(request, url=parts._replace(query="").geturl(), params=tuple(kept.items()))
    return None if after == request else after


def pages(fetch: Fetch, first: Request, records: str, follow: Callable[[Request, Answer], Request | None]) -> Iterator[dict]:
    """Records (under a dotted path) of a request's pages, until one is empty or leads no further."""
    request: Request | None = first
    while request is not None:
        answer = fetch(request)
        own = at_path(answer.json(), records) or []
        yield from own
        request = follow(request, answer) if own else None


# --- typed rows
def _text(v: object) -> str | None:
    return None if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, sort_keys=True) if isinstance(v, (dict, list)) else str(v)


def _number(v: object, make: type) -> object:
    try:
        return None if v is None or v == "" else make(v)
    except (TypeError, ValueError):
        return None


#: "Y" and true say yes; an absent value says no.
YES = ("y", "yes", "true", "1")


def decoder(schema: StructType, names: dict[str, str] | None = None) -> Callable[[dict], tuple]:
    """A record's fields as the columns of ``schema``; ``names`` has a dotted path where it isn't the name.

    What isn't of a column's type is null, so one odd value doesn't cost the record.
    """
    casts = {StringType: _text, LongType: lambda v: _number(v, int), IntegerType: lambda v: _number(v, int), DoubleType: lambda v: _number(v, float), BooleanType: lambda v: str(v).lower() in YES if v is not None else False}
    plan = [((names or {}).get(f.name, f.name), casts[type(f.dataType)]) for f in schema]
    return lambda record: tuple(cast(at_path(record, path)) for path, cast in plan)


#: Ten fields of an article, and where a literature service has them.
ARTICLE = "id string, source string, title string, author_string string, journal_title string, pub_year string, pmcid string, doi string, cited_by_count int, is_open_access boolean"
ARTICLE_PATHS = {"author_string": "authorString", "journal_title": "journalTitle", "pub_year": "pubYear", "cited_by_count": "citedByCount", "is_open_access": "isOpenAccess"}


@dataclass
class Range(InputPartition):
    """Keys lo (included) to hi (not)."""

    lo: int
    hi: int

    def __init__(self, lo: int, hi: int):
        super().__init__((lo, hi))
        self.lo, self.hi = lo, hi


def ranges(lo: int, hi: int, size: int) -> list[Range]:
    return [Range(at, min(hi, at + size)) for at in range(lo, hi, size)]


def ranged_source(
    source_name: str, schema: str, first: Callable[[int, int], Request], fetch: Fetch, records: str, follow: Callable[[Request, Answer], Request | None], upto: Callable[[], int],
    *, names: dict[str, str] | None = None, start: int = 0, range_keys: int = 10_000,
) -> type[DataSource]:
    """A data source, for batch and stream, of the records of all keys from ``start`` to ``upto()``.

    ``first(lo, hi)`` is the request of a range of ``range_keys`` keys, which a task pages through; a batch
    of the stream has the keys that ``upto()`` has grown by.
    """
    kinds = _parse_datatype_string(schema)
    decode = decoder(kinds, names)

    def rows(part: Range) -> Iterator[tuple]:
        for record in pages(fetch, first(part.lo, part.hi), records, follow):
            yield decode(record)

    class Whole(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            return ranges(start, upto(), range_keys)

        def read(self, partition: Range) -> Iterator[tuple]:
            return rows(partition)

    class Stream(DataSourceStreamReader):
        def initialOffset(self) -> dict:
            return {"upto": start}

        def latestOffset(self) -> dict:
            return {"upto": upto()}

        def partitions(self, begin: dict, end: dict) -> list[InputPartition]:
            return ranges(begin["upto"], end["upto"], range_keys)

        def read(self, partition: Range) -> Iterator[tuple]:
            return rows(partition)

        def commit(self, end: dict) -> None:
            """Nothing to let go: what was asked for can be asked for again."""

    class Ranged(DataSource):
        @classmethod
        def name(cls) -> str:
            return source_name

        def schema(self) -> StructType:
            return kinds

        def reader(self, schema) -> DataSourceReader:
            return Whole()

        def streamReader(self, schema) -> DataSourceStreamReader:
            return Stream()

    return Ranged
