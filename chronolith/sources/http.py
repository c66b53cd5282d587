"""HTTP adapters: a multimodal model's chat endpoint, and files with a size limit."""

from __future__ import annotations

import email.utils
import http.client
import json
import os
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import UTC

from .. import constants as C
from .adapters import RetryableError, with_retries

#: Statuses besides 500 to 599 after which a request may be tried again (fixed values of the protocol).
MODEL_STATUSES = frozenset({408, 425, 429})
DOWNLOAD_STATUSES = frozenset({408, 429})
#: What goes wrong on the way, while a connection is made or read.
ON_THE_WAY = (urllib.error.URLError, TimeoutError, ConnectionError, http.client.HTTPException)


def asked_delay(header: str | None, now: float | None = None) -> float | None:
    """Seconds of a Retry-After header, as a number or a date (UTC without a zone); None if it says neither."""
    if not header:
        return None
    try:
        return max(0.0, float(header))
    except ValueError:
        pass
    try:
        date = email.utils.parsedate_to_datetime(header)
    except (TypeError, ValueError, OverflowError):
        return None
    date = date if date.tzinfo else date.replace(tzinfo=UTC)
    return max(0.0, date.timestamp() - (time.time() if now is None else now))


@contextmanager
def open_url(request: urllib.request.Request, timeout: float, statuses: frozenset[int], opener: Callable = urllib.request.urlopen) -> Iterator:
    """The response; failures that may pass, of opening as of reading it, are raised as retryable."""
    try:
        with opener(request, timeout=timeout) as response:
            yield response
    except urllib.error.HTTPError as e:
        if e.code in statuses or 500 <= e.code <= 599:
            raise RetryableError(f"status {e.code}", asked_delay(e.headers.get("Retry-After"))) from e
        try:
            said = e.read()[:300].decode("utf-8", "replace")
        except (OSError, http.client.HTTPException):
            said = ""
        raise RuntimeError(f"status {e.code}: {said}") from e
    except ON_THE_WAY as e:
        raise RetryableError(f"{type(e).__name__}: {e}") from e


class ChatModel:
    """Sends a row's prompt with its media (a URL or data URL in media_url) and returns the answer's text.

    An answer that can't be read or has no text may be better next time; media above the upload limit aren't sent.
    """

    def __init__(self, endpoint: str, model: str, key: str, timeout: float = 240.0, opener: Callable = urllib.request.urlopen, most_bytes: int = C.MAX_UPLOAD_BYTES):
        self.endpoint, self.model, self.key, self.timeout, self.opener, self.most = endpoint, model, key, timeout, opener, most_bytes

    def __call__(self, row: dict) -> dict:
        head, _, data = row["media_url"].partition(",")
        if head.startswith("data:") and len(data) * 3 // 4 - data[-2:].count("=") > self.most:
            raise RuntimeError(f"the media have more than {self.most} bytes")
        parts = [{"type": "video_url", "video_url": {"url": row["media_url"]}}, {"type": "text", "text": row["prompt"]}]
        body = json.dumps({"model": self.model, "temperature": 0.0, "messages": [{"role": "user", "content": parts}]}).encode()
        request = urllib.request.Request(self.endpoint, body, {"Authorization": f"Bearer {self.key}", "Content-Type": "application/json"})
        with open_url(request, self.timeout, MODEL_STATUSES, self.opener) as response:
            raw = response.read()
        return {"text": self._text(raw)}

    @staticmethod
    def _text(raw: bytes) -> str:
        try:
            content = json.loads(raw)["choices"][0]["message"]["content"]
        except (ValueError, KeyError, IndexError, TypeError) as e:
            raise RetryableError("the model's answer can't be read") from e
        if isinstance(content, list):
            content = "\n".join(p["text"] for p in content if isinstance(p, dict) and isinstance(p.get("text"), str))
        if not isinstance(content, str) or not content.strip():
            raise RetryableError("the model's answer has no text")
        return content


class FileInfo:
    """Asks a wiki's query interface about each row's title; `readers.file_infos` reads the answers. A missing file is an error."""

    def __init__(self, endpoint: str, timeout: float = 60.0, opener: Callable = urllib.request.urlopen):
        self.endpoint, self.timeout, self.opener = endpoint, timeout, opener

    def __call__(self, row: dict) -> dict:
        asked = {"action": "query", "format": "json", "formatversion": 2, "prop": "imageinfo", "iiprop": "url|size|mime|sha1|extmetadata", "titles": row["title"]}
        with open_url(urllib.request.Request(f"{self.endpoint}?{urllib.parse.urlencode(asked)}"), self.timeout, DOWNLOAD_STATUSES, self.opener) as response:
            page = json.loads(response.read())["query"]["pages"][0]
        if page.get("missing"):
            raise RuntimeError(f"no such file: {row['title']}")
        return page


class Download:
    """Fetches a row's url to its path, by way of a part file: all or nothing.

    A given size must be between 1 and the limit, and is what must arrive; less or more may be better next time.
    """

    def __init__(self, most_bytes: int = 150 * 1024 * 1024, timeout: float = 120.0, opener: Callable = urllib.request.urlopen):
        self.most, self.timeout, self.opener = most_bytes, timeout, opener

    def __call__(self, row: dict) -> dict:
        size, part = row.get("size"), f"{row['path']}.part"
        if size is not None and not 1 <= size <= self.most:
            raise RuntimeError(f"{size} bytes are outside 1 to {self.most}")
        try:
            with open(part, "wb") as f, open_url(urllib.request.Request(row["url"]), self.timeout, DOWNLOAD_STATUSES, self.opener) as response:
                got = sum(map(f.write, self._blocks(response)))
            if size not in (None, got):
                raise RetryableError(f"{got} bytes instead of {size}")
            os.replace(part, row["path"])
        finally:
            if os.path.exists(part):
                os.remove(part)
        return {"path": row["path"], "size": got}

    def _blocks(self, response) -> Iterator[bytes]:
        left = self.most
        for block in iter(lambda: response.read(1 << 20), b""):
            left -= len(block)
            if left < 0:
                raise RuntimeError(f"more than {self.most} bytes")
            yield block


def fetch(url: str, path: str, size: int | None = None, attempts: int = 5, sleep: Callable[[float], None] = time.sleep, **more) -> dict:
    """A download with retries, a second to half a minute apart."""
    return with_retries(Download(**more), {"url": url, "path": path, "size": size}, attempts, sleep=sleep, within=(1.0, 30.0))[0]
