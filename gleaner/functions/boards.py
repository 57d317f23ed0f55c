"""Job boards: which platform a url belongs to, and its API url; records.py reads what the API says."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import url_host, url_path


def platform(url) -> Column:
    host = url_host(url)
    # Hosts of the four platforms.
    return F.when(host.isin("job-boards.greenhouse.io", "boards.greenhouse.io"), "greenhouse").when(host == "jobs.ashbyhq.com", "ashby").when(host == "jobs.lever.co", "lever").when(host.endswith(".myworkdayjobs.com"), "workday")


def api_url(url) -> Column:
    """The url of a posting's JSON; null where the path has not the platform's form."""
    kind, host, path = platform(url), url_host(url), F.concat(url_path(url), F.lit("/"))
    part = lambda p, i: F.regexp_extract(path, p, i)
    two = r"^/+([^/]+)/+([^/]+)/"
    house = r"^/+([^/]+)/+jobs/+([^/]+)/"
    day = r"^/+(?:[a-z]{2}(?:-[A-Z]{2})?/+(?=[^/]))?([^/]+)/+job/+(.*[^/])/+$"
    return (
        F.when((kind == "greenhouse") & (part(house, 2) != ""), F.concat(F.lit("https://boards-api.greenhouse.io/v1/boards/"), part(house, 1), F.lit("/jobs/"), part(house, 2)))
        .when((kind == "ashby") & (part(r"^/+([^/]+)/", 1) != ""), F.concat(F.lit("https://api.ashbyhq.com/posting-api/job-board/"), part(r"^/+([^/]+)/", 1), F.lit("?includeCompensation=true")))
        .when((kind == "lever") & (part(two, 2) != ""), F.concat(F.lit("https://api.lever.co/v0/postings/"), part(two, 1), F.lit("/"), part(two, 2)))
        .when((kind == "workday") & (part(day, 2) != ""), F.concat(F.lit("https://"), host, F.lit("/wday/cxs/"), F.substring_index(host, ".", 1), F.lit("/"), part(day, 1), F.lit("/job/"), F.regexp_replace(part(day, 2), "/+", "/")))
    )
