"""HTTP libraries from a dict: base address, authentication, headers, retries and rate limits in one place.

A library is a Python file with a dict ``API`` and functions that take ``http``: ``fetch`` or ``submit``,
``check`` and ``fetch_result`` for reading, ``push`` and ``finalize`` for writing.  Requests run on the
driver, as a fetch does; rows go to the durable buffer page by page.
"""

from __future__ import annotations

import base64
import json
import os
import re
import runpy
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from .fetch import Library, call, library
from .net import RateLimit, Retry, retryable, with_retries


class ApiError(RuntimeError):
    pass


def seconds(text: str | float) -> float:
    """500ms, 5s, 5m, 1h or a number of seconds."""
    m = re.fullmatch(r"\s*([\d.]+)\s*(ms|s|m|h)?\s*", str(text))
    if not m:
        raise ApiError(f"not a duration: {text}")
    return float(m[1]) * {"ms": 0.001, None: 1, "s": 1, "m": 60, "h": 3600}[m[2]]


@dataclass
class Response:
    status: int
    text: str
    headers: dict[str, str] = field(default_factory=dict)

    @property
    def ok(self) -> bool:
        return self.status < 400

    def json(self):
        return json.loads(self.text) if self.text else None


def authorize(auth: dict | None, env: dict[str, str], token: Callable[[str], str | None] | None = None) -> tuple[dict[str, str], dict[str, str]]:
    """(headers, query parameters) that an auth dict asks for.

    {"env": NAME} with "header" or "param", {"user": .., "pass": ..}, {"provider": NAME} with the token in
    OAUTH_TOKEN_NAME or given by ``token``, and {"token": function} for flows of the caller's own.
    """
    if not auth:
        return {}, {}

    def value(x) -> str:
        name = x["env"] if isinstance(x, dict) else None
        found = env.get(name) if name else x
        if not found:
            raise ApiError(f"{name} is not set")
        return found

    if "user" in auth:
        pair = f"{value(auth['user'])}:{value(auth['pass'])}".encode()
        return {"Authorization": "Basic " + base64.b64encode(pair).decode()}, {}
    if "env" in auth:
        key = value({"env": auth["env"]})
        if "header" in auth:
            return {auth["header"]: key}, {}
        return ({}, {auth["param"]: key}) if "param" in auth else ({"Authorization": f"Bearer {key}"}, {})
    if "provider" in auth:
        found = env.get("OAUTH_TOKEN_" + auth["provider"].upper().replace("-", "_")) or (token(auth["provider"]) if token else None)
        if not found:
            raise ApiError(f"no token of {auth['provider']}")
        return {"Authorization": f"Bearer {found}"}, {}
    if callable(auth.get("token")):
        return {"Authorization": f"Bearer {auth['token']()}"}, {}
    raise ApiError(f"unknown auth: {sorted(auth)}")


class Http:
    """Requests with an API dict's defaults; arguments of a call go before them."""

    def __init__(self, api: dict, env: dict[str, str] | None = None, limit: dict | None = None, token: Callable[[str], str | None] | None = None, sleep: Callable[[float], None] | None = None):
        self.api, self.env, self.token = api, dict(os.environ) if env is None else env, token
        limit = limit or api.get("rate_limit")
        self.limit = RateLimit(limit["requests"], seconds(limit.get("per", 1))) if limit else None
        self.wait = {"sleep": sleep} if sleep else {}

    def request(self, method: str, url: str, params: dict | None = None, headers: dict | None = None, json_body=None, data: str | bytes | None = None, **own) -> Response:
        base = self.api.get("base_url")
        if base and "://" not in url:
            url = f"{base.rstrip('/')}/{url.lstrip('/')}"
        more, query = authorize(own["auth"] if "auth" in own else self.api.get("auth"), self.env, self.token)
        headers = {**self.api.get("headers", {}), **more, **(headers or {})}
        query = {**query, **(params or {})}
        if query:
            url += ("&" if "?" in url else "?") + urllib.parse.urlencode(query, doseq=True)
        if json_body is not None:
            data, headers = json.dumps(json_body, default=str), {"Content-Type": "application/json", **headers}
        body = data.encode() if isinstance(data, str) else data

        def once() -> Response:
            if self.limit:
                self.limit.take()
            request = urllib.request.Request(url, body, headers, method=method)
            try:
                with urllib.request.urlopen(request, timeout=own.get("timeout", self.api.get("timeout", 30))) as got:
                    return Response(got.status, got.read().decode("utf-8", "replace"), dict(got.headers))
            except urllib.error.HTTPError as e:
                answer = Response(e.code, e.read().decode("utf-8", "replace"), dict(e.headers))
                if retryable(e.code):
                    after = e.headers.get("Retry-After")
                    again = Retry(f"{method} {url}: {e.code}", float(after) if after and after.isdigit() else None)
                    again.answer = answer
                    raise again from e
                return answer
            except urllib.error.URLError as e:
                raise Retry(f"{method} {url}: {e.reason}") from e

        try:
            return with_retries(once, 1 + own.get("retry", self.api.get("retry", 0)), own.get("backoff", self.api.get("backoff", 1)), **self.wait)
        except Retry as e:
            if answer := getattr(e, "answer", None):
                return answer
            raise ApiError(str(e)) from e

    def __getattr__(self, name: str):
        if name in ("get", "post", "put", "patch", "delete", "head"):
            return lambda url, json=None, **more: self.request(name.upper(), url, json_body=json, **more)
        raise AttributeError(name)


def write_faults(writes: dict) -> list[tuple[str, str]]:
    """(rule, message) for each setting of an API's ``push`` that does not fit the others."""
    out, mode, workers = [], writes.get("batch_mode", "sync"), writes.get("max_concurrent", 1)
    if mode not in ("sync", "atomic", "async"):
        out.append(("push.invalid_batch_mode", f"unknown batch_mode {mode}"))
    elif workers > 1 and mode != "sync":
        out.append(("push.invalid_max_concurrent", f"batch_mode {mode} with max_concurrent {workers}"))
    per = (writes.get("rate_limit") or {}).get("per")
    for key, value in (("poll_interval", writes.get("poll_interval")), ("poll_timeout", writes.get("poll_timeout")), ("rate_limit", per)):
        if value is None:
            continue
        if key != "rate_limit" and mode != "async":
            out.append((f"push.invalid_{key}", f"{key} needs batch_mode async, not {mode}"))
        try:
            seconds(value)
        except (ApiError, ValueError):
            out.append((f"push.invalid_{key}", f"{key} {value} is not a duration"))
    return out


def library_of(name: str, parts: dict, env: dict[str, str] | None = None, token=None, sleep=None) -> Library:
    """A library from a file's names: ``API`` and its functions."""
    api = parts.get("API")
    if not isinstance(api, dict):
        raise ApiError(f"{name}: no dict API")
    reads, writes = api.get("fetch") or {}, api.get("push") or {}
    if faults := write_faults(writes):
        raise ApiError(f"{name}: " + "; ".join(why for _, why in faults))
    http = {"fetch": Http(api, env, reads.get("rate_limit"), token, sleep), "push": Http(api, env, writes.get("rate_limit"), token, sleep)}
    if bool(reads.get("async")) != ("submit" in parts) and reads:
        raise ApiError(f"{name}: async needs submit(), check() and fetch_result(), and only then")
    mode = writes.get("batch_mode", "sync")

    def bound(function: str, side: str):
        fn = parts.get(function)
        if fn is None:
            return None

        def run(*args, **known):
            return call(fn, *args, **known, http=http[side], page_size=reads.get("page_size", 0))

        return run

    side, poll = ("fetch", reads) if reads.get("async") else ("push", writes)
    return Library(
        name, bound("fetch", "fetch"), bound("submit", side), bound("check", side), bound("fetch_result", side), bound("push", "push"), bound("finalize", "push"),
        seconds(poll.get("poll_interval", "5s")), float(poll.get("poll_backoff", 1)), seconds(poll.get("poll_timeout", "5m" if side == "fetch" else "1h")),
        batch_size=writes.get("batch_size", 1), mode=mode if writes else None, workers=writes.get("max_concurrent", 1),
        supported_columns=reads.get("supported_columns"), fetch_kinds=reads.get("supported_kinds"), push_kinds=writes.get("supported_kinds"),
    )


def library_files(folder: str) -> dict[str, dict]:
    """The names of every file of a project's ``lib`` that has an ``API``, by the file's name."""
    files = {path.stem: runpy.run_path(str(path)) for path in sorted(Path(folder, "lib").glob("*.py"))}
    return {name: parts for name, parts in files.items() if "API" in parts}


def load_libraries(folder: str, env: dict[str, str] | None = None, token=None) -> list[str]:
    """Register every file of a project's ``lib`` that has an ``API``; its name is the file's."""
    files = library_files(folder)
    for name, parts in files.items():
        library(library_of(name, parts, env, token))
    return list(files)


__all__ = ["ApiError", "Http", "Response", "authorize", "library_files", "library_of", "load_libraries", "seconds", "write_faults"]
