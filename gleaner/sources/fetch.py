"""Files and web pages as tables.

Requests are polite: a pause before each, one more try after 429 or 503 within the time the server asks for, and a host
is asked by one task and for one page at a time, so that the pause holds. A task asks its hosts in turn, each when it may
be asked again, so the waits of one serve the others. What goes wrong is a row's `error`, never a job's end. The transport
is injected: fetcher(url) -> dict(status, retry_after, final_url, body), which workers must be able to import or unpickle,
and which a task calls from several threads.
"""

from __future__ import annotations

import heapq
import time
from collections import defaultdict, deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor
from concurrent.futures import wait as first_of
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.extraction import comp, main_text, remote, req_id
from ..functions.text import company_from_title, url_host

# Seconds of the pause, of a wait that no one named, and of the longest one; retries.
PAUSE, USUAL_WAIT, LONGEST_WAIT, RETRIES = 0.3, 2.0, 30.0, 1
# Requests of a task that may be on their way at once, and urls that it holds ready.
AT_ONCE, AHEAD = 16, 4_096
_ANSWER = "url string, status int, final_url string, body string, error string, kind string"

Fetcher = Callable[[str], dict]


class RateLimited(Exception):
    pass


def wait_asked(value: str | None, now: datetime | None = None) -> float:
    """Seconds of a Retry-After: a number, or a date (none in the past); USUAL_WAIT where it can't be read."""
    if value is None:
        return USUAL_WAIT
    if value.strip().isdigit():
        return float(value)
    try:
        at = parsedate_to_datetime(value.strip())
    except ValueError:
        return USUAL_WAIT
    return max(0.0, (at - (now or datetime.now(UTC))).total_seconds())


def politely(fetcher: Fetcher, url: str, sleep: Callable[[float], None] = time.sleep, pause: float = PAUSE) -> dict:
    """One url's answer, waits included."""
    for tried in range(RETRIES + 1):
        sleep(pause)
        answer = fetcher(url)
        if (wait := _wait_again(url, answer, tried)) is None:
            return answer
        sleep(wait)
    raise AssertionError("not reached")


def _wait_again(url: str, answer: dict, tried: int) -> float | None:
    """Seconds to wait before the same url is asked again; None if the answer stands."""
    if answer["status"] not in (429, 503) or tried == RETRIES:
        return None
    wait = wait_asked(answer.get("retry_after"))
    if wait > LONGEST_WAIT:
        raise RateLimited(f"{url}: asked to wait {wait:.0f} s")
    return wait


def in_turn(todo: Iterable[tuple[str, str]], fetcher: Fetcher, pause: float = PAUSE, at_once: int = AT_ONCE, ahead: int = AHEAD) -> Iterator[tuple[str, dict | Exception]]:
    """(url, answer or what went wrong) of (host, url)s, as they come in.

    Each host has a queue and a time from which it may be asked again: a pause after its last answer, and the wait that it
    asked for. The one whose time comes first is next; no host has two requests on their way. `todo` is read as far as
    `ahead` urls are waiting, so order it by turns: the first url of every host, then the second.
    """
    todo, waiting, held = iter(todo), defaultdict(deque), 0
    turns: list[tuple[float, str]] = []  # hosts with a url waiting and none on its way
    free_at: dict[str, float] = {}
    away, busy = {}, set()
    with ThreadPoolExecutor(at_once) as pool:
        while True:
            while held < ahead and (more := next(todo, None)) is not None:
                host, url = more
                held += 1
                if not waiting[host] and host not in busy:
                    heapq.heappush(turns, (free_at.get(host, time.monotonic() + pause), host))
                waiting[host].append((url, 0))
            while turns and len(away) < at_once and turns[0][0] <= time.monotonic():
                host = heapq.heappop(turns)[1]
                url, tried = waiting[host].popleft()
                busy.add(host)
                away[pool.submit(fetcher, url)] = host, url, tried
            if not away and not turns:
                return
            due = max(0.0, turns[0][0] - time.monotonic()) if turns and len(away) < at_once else None
            if not away:
                time.sleep(due)
                continue
            for done in first_of(away, due, FIRST_COMPLETED).done:
                host, url, tried = away.pop(done)
                busy.discard(host)
                wait = None
                try:
                    answer = done.result()
                    wait = _wait_again(url, answer, tried)
                except Exception as e:  # one url's failure is its own
                    answer = e
                free_at[host] = time.monotonic() + pause + (wait or 0.0)
                if wait is not None:
                    waiting[host].appendleft((url, tried + 1))
                else:
                    held -= 1
                    yield url, answer
                if waiting[host]:
                    heapq.heappush(turns, (free_at[host], host))
                else:
                    del waiting[host]


def _told(url: str, a: dict | Exception) -> dict:
    row = dict.fromkeys(("status", "final_url", "body", "error", "kind")) | {"url": url}
    try:
        if isinstance(a, Exception):
            raise a
        row |= {"status": a["status"], "final_url": a.get("final_url", url)}
        if 200 <= a["status"] < 300:
            return row | {"body": a["body"]}
        return row | {"error": f"status {a['status']}", "kind": "rate_limited" if a["status"] in (429, 503) else "status"}
    except RateLimited as e:
        return row | {"error": f"RateLimited: {e}", "kind": "rate_limited"}
    except Exception as e:
        return row | {"error": f"{type(e).__name__}: {e}", "kind": "transport"}


def pages(urls: DataFrame, fetcher: Fetcher, pause: float = PAUSE) -> DataFrame:
    """(url, status, final_url, body, error, kind) of the distinct urls; hosts are spread over tasks, each whole in one.

    kind tells what went wrong: `transport` or `rate_limited`, after which the host is not to be asked again for the same
    posting, or `status`, which says nothing about other pages of it.
    """

    def read(batches):
        import pandas as pd

        todo = (x for b in batches for x in zip(b["host"], b["url"], strict=True))
        for url, answer in in_turn(todo, fetcher, pause):
            row = _told(url, answer)
            yield pd.DataFrame({"url": [url], "status": pd.array([row["status"]], "Int32")} | {k: [row[k]] for k in ("final_url", "body", "error", "kind")})

    n = int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number, so that few urls aren't one task
    todo = urls.select("url").where("url is not null").distinct().withColumn("host", url_host("url")).repartition(n, "host")
    todo = todo.withColumn("turn", F.row_number().over(Window.partitionBy("host").orderBy("url"))).sortWithinPartitions("turn", "host")
    return todo.select("host", "url").mapInPandas(read, _ANSWER)


def local_files(spark: SparkSession, path: str) -> DataFrame:
    """Postings dropped as files: path, title, company, req_id, location, remote, comp, url, raw_text, error.

    HTML gives its title and its main text, as a fetched page does; other files are taken as they are, titled by their first line that isn't
    blank, without leading #. The company comes from the title. A file without text is an error.
    """
    f = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    is_html = F.col("path").rlike(r"(?i)\.html?$")
    first = F.regexp_replace(F.trim(F.regexp_extract("value", r"(?m)^[ \t]*(\S[^\r\n]*)", 1)), r"^#+\s*", "")
    f = f.withColumn("_main", main_text(F.when(is_html, F.col("value"))))
    f = f.withColumns({"raw_text": F.when(is_html, F.col("_main.text")).otherwise(F.col("value")), "title": F.when(is_html, F.col("_main.title")).otherwise(F.nullif(first, F.lit("")))})
    empty = F.coalesce(F.trim(F.regexp_replace("raw_text", r"\s+", " ")) == "", F.lit(True))
    nothing = F.lit(None).cast("string")
    return f.select(
        "path", "title", company_from_title("title").alias("company"), req_id("raw_text").alias("req_id"), nothing.alias("location"), remote(nothing, "raw_text").alias("remote"), comp("raw_text").alias("comp"),
        nothing.alias("url"), "raw_text", F.when(empty, "no text").alias("error"),
    )
