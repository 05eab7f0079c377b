"""Paths of archived pages, as requests name them."""

from __future__ import annotations

import posixpath
from urllib.parse import unquote, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.schemas import InvalidPath


def _decoded(text: str) -> str:
    for k, c in enumerate(text):
        if c == "%" and not (len(text) > k + 2 and all(x in "0123456789abcdefABCDEF" for x in text[k + 1 : k + 3])):
            raise InvalidPath(f"bad escape in {text!r}")
    return unquote(text, errors="strict")


def archive_path(raw: str) -> tuple[str, str]:
    """(domain, filename) of a request path or url such as /archive/a.com/dir/page.html."""
    raw = raw.strip()
    if not raw:
        raise InvalidPath("path is empty")
    path = urlsplit(raw).path if "://" in raw else raw
    try:
        # A url is decoded when it is taken apart and once more afterwards, a plain path likewise.
        path = _decoded(_decoded(path))
    except UnicodeDecodeError as error:
        raise InvalidPath(str(error)) from error
    path = path.removeprefix("/")
    if not path.startswith("archive/"):
        raise InvalidPath("path is outside the archive")
    segments = path.removeprefix("archive/").split("/")
    if len(segments) < 2 or any(s in ("", ".", "..") for s in segments):
        raise InvalidPath(f"bad path {raw!r}")
    domain, filename = segments[0].strip(), "/".join(segments[1:])
    if not domain:
        raise InvalidPath("domain is empty")
    return domain, filename


def inside(root: str, path: str) -> bool:
    """Whether a path stays below a root after ``..`` is worked out."""
    root = posixpath.normpath(root)
    return posixpath.normpath(path).startswith(root.rstrip("/") + "/")


def resolved(requests: DataFrame, column: str = "path") -> DataFrame:
    """``requests`` with domain, filename and error of each request path or url in ``column``."""

    @F.pandas_udf("domain string, filename string, error string")
    def parts(paths: pd.Series) -> pd.DataFrame:
        rows = []
        for raw in paths:
            try:
                rows.append((*archive_path(raw or ""), None))
            except InvalidPath as error:
                rows.append((None, None, str(error)))
        return pd.DataFrame(rows, columns=["domain", "filename", "error"], dtype="object")

    return requests.withColumn("_lf_parts", parts(column)).select(*[F.col(f"`{c}`") for c in requests.columns], "_lf_parts.*")
