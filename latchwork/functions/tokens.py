"""Canonical JSON, digests, and signed tokens for cursors and snapshots."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import time

from ..errors import EngineError


def canonical(value) -> bytes:
    """One byte string for equal values: keys in order, no white space, no floats that JSON can't tell apart."""
    try:
        return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()
    except (TypeError, ValueError) as e:
        raise EngineError("format/invalid", f"not a plain value: {e}") from e


def digest(value) -> str:
    return hashlib.sha256(canonical(value)).hexdigest()


def b64(data: bytes) -> str:
    return base64.urlsafe_b64encode(data).rstrip(b"=").decode()


def unb64(text: str) -> bytes:
    return base64.urlsafe_b64decode(text + "=" * (-len(text) % 4))


class Signer:
    """Tokens that carry a payload, signed with HMAC-SHA256 under a key derived for their purpose."""

    def __init__(self, key: bytes, purpose: str, seconds: int | None = None, largest: int = 16_384):
        self.key = hmac.new(key, purpose.encode(), hashlib.sha256).digest()
        self.purpose, self.seconds, self.largest = purpose, seconds, largest

    def issue(self, payload: dict, scope: dict, now: int | None = None) -> str:
        now = int(time.time()) if now is None else now
        body = {"payload": payload, "scope": digest(scope), "issued": now, "expires": now + self.seconds if self.seconds else None}
        data = canonical(body)
        return f"{self.purpose}.{b64(data)}.{b64(hmac.new(self.key, data, hashlib.sha256).digest())}"

    def read(self, token: str, scope: dict, now: int | None = None) -> dict:
        bad = EngineError(f"{self.purpose}/invalid", "the token isn't one of this engine's")
        if not isinstance(token, str) or len(token) > self.largest or token.count(".") != 2:
            raise bad
        purpose, data, mark = token.split(".")
        try:
            raw, given = unb64(data), unb64(mark)
        except ValueError:
            raise bad from None
        if purpose != self.purpose or not hmac.compare_digest(given, hmac.new(self.key, raw, hashlib.sha256).digest()):
            raise bad
        body = json.loads(raw)
        if body["scope"] != digest(scope):
            raise EngineError(f"{self.purpose}/scope-mismatch", "the token belongs to another request")
        now = int(time.time()) if now is None else now
        if body["expires"] is not None and now >= body["expires"]:
            raise EngineError(f"{self.purpose}/expired", "the token has expired")
        return body["payload"]
