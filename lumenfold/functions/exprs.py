"""Column expressions over pages, paths, urls and tasks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenfold.functions.url_grammar import parsed_url

TITLE = r"(?id)<title>(.*?)</title>"
#: Erased from extracted text: space, line feed, carriage return and a written-out \n.
ERASED = r" |\n|\r|\\n"
_SPACE = r"\p{IsWhite_Space}"


def _c(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def trimmed(column: Column | str) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(_c(column), rf"^{_SPACE}+|{_SPACE}+\z", "")


def html_title(html: Column | str) -> Column:
    """The first title as written, null where there is none; an empty title is one."""
    return F.when(_c(html).rlike(TITLE), F.regexp_extract(_c(html), TITLE, 1))


def erase_space(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), ERASED, "")


def is_html_file(name: Column | str) -> Column:
    return _c(name).rlike(r"(?i)\.html?\z")


def url_domain(url: Column | str) -> Column:
    """Lower-case host of an http(s) url without its port, empty if it has none."""
    return F.regexp_extract(F.lower(trimmed(url)), r"^https?://(?:[^/?#@]*@)?\[?([^/:?#\]]+)", 1)


def normal_url(url: Column | str) -> Column:
    """struct(url, domain, error): trimmed and parsed, scheme in lower case, without fragment."""
    return parsed_url(trimmed(url))


def request_path(domain: Column | str, filename: Column | str) -> Column:
    return F.concat(F.lit("/archive/"), _c(domain), F.lit("/"), _c(filename))


def task_http_code(status: Column | str, created: Column | None = None) -> Column:
    """202 for a task just made or still active, else 200."""
    active = _c(status).isin("pending", "running")
    return F.when(active if created is None else created | active, 202).otherwise(200)


def share_percent(part: Column, total: Column) -> Column:
    """Percent of a total, halves rounded up; 0 without a positive total."""
    return F.when(total > 0, F.floor(100.0 * part / total + 0.5)).otherwise(0).cast("long")
