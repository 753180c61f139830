"""Continuation cursors: opaque, bound to their query and account, strictly checked. Errors as data."""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
from dataclasses import asdict, dataclass


class QueryError(Exception):
    """A failure that callers get as data."""

    def __init__(self, code: str, retryable: bool = False, **details: object):
        super().__init__(code)
        self.code, self.retryable, self.details = code, retryable, details

    def result(self) -> dict:
        return {"status": "needs_choice" if "candidates" in self.details else "error", "error": self.code, "retryable": self.retryable, "nextAction": self.details.pop("nextAction", None), **self.details}


@dataclass(frozen=True)
class Cursor:
    account: str
    contact: str
    since: int | None
    until: int | None
    contains: str | None
    around: int | None
    self_only: bool
    key: tuple

    def binding(self) -> str:
        q = {k: v for k, v in asdict(self).items() if k != "key"}
        return hashlib.sha256(json.dumps(q, sort_keys=True, ensure_ascii=False).encode()).hexdigest()

    def encode(self) -> str:
        body = {"v": 1, "binding": self.binding(), "key": list(self.key)}
        return base64.urlsafe_b64encode(json.dumps(body, separators=(",", ":"), ensure_ascii=False).encode()).decode().rstrip("=")

    @classmethod
    def key_of(cls, text: str, query: Cursor) -> tuple:
        """The key in a cursor of this very query; anything else is an error."""
        try:
            body = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
        except (binascii.Error, ValueError) as e:
            raise QueryError("cursor_invalid") from e
        fits = isinstance(body, dict) and set(body) == {"v", "binding", "key"} and body["v"] == 1 and isinstance(body["key"], list) and len(body["key"]) in (5, 6)
        if not fits or not all(isinstance(x, int) for x in body["key"][:-2]) or not all(isinstance(x, str) for x in body["key"][-2:]):
            raise QueryError("cursor_invalid")
        if body["binding"] != query.binding():
            raise QueryError("cursor_query_mismatch")
        return tuple(body["key"])


def default_window(now: int, lookback: int, around: int | None, since: int | None, until: int | None) -> tuple[int, int]:
    """The time window of a query that names none: about ``around``, or the last ``lookback`` seconds."""
    if around is not None:
        return (since if since is not None else around - lookback, until if until is not None else around + lookback)
    end = until if until is not None else now
    return (since if since is not None else end - lookback, end)


def exit_code(error: BaseException | None) -> int:
    return 0 if error is None else 130 if isinstance(error, KeyboardInterrupt) else 2
