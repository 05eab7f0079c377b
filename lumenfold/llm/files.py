"""Files in the shared folder, for tasks: a local path or any scheme that Arrow opens."""

from __future__ import annotations

import os
import uuid
from urllib.parse import urlparse


def write_file(url: str, content: bytes) -> None:
    """Write a whole file under its name at once, so that a retried task replaces it by an equal one."""
    parts = urlparse(url)
    temporary = f"{uuid.uuid4().hex}.tmp"
    if parts.scheme in ("", "file"):
        folder = os.path.dirname(parts.path)
        os.makedirs(folder, exist_ok=True)
        with open(f"{folder}/.{temporary}", "wb") as out:
            out.write(content)
        os.replace(f"{folder}/.{temporary}", parts.path)
        return
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(url)
    folder = path.rpartition("/")[0]
    system.create_dir(folder, recursive=True)
    with system.open_output_stream(f"{folder}/.{temporary}") as out:
        out.write(content)
    system.move(f"{folder}/.{temporary}", path)
