"""AWS Signature Version 4 of requests, from its public specification."""

from __future__ import annotations

import configparser
import dataclasses
import datetime
import hashlib
import hmac
import os
import urllib.parse


@dataclasses.dataclass(frozen=True)
class Credentials:
    key: str
    secret: str
    token: str | None = None


def credentials(env: dict[str, str] | None = None) -> Credentials:
    """From the environment, else from the profile in the shared credentials file."""
    env = dict(os.environ) if env is None else env
    if env.get("AWS_ACCESS_KEY_ID") and env.get("AWS_SECRET_ACCESS_KEY"):
        return Credentials(env["AWS_ACCESS_KEY_ID"], env["AWS_SECRET_ACCESS_KEY"], env.get("AWS_SESSION_TOKEN") or None)
    path = env.get("AWS_SHARED_CREDENTIALS_FILE") or os.path.join(env.get("HOME", ""), ".aws", "credentials")
    ini = configparser.RawConfigParser()
    ini.read(path)
    profile = env.get("AWS_PROFILE") or "default"
    if not ini.has_option(profile, "aws_access_key_id") or not ini.has_option(profile, "aws_secret_access_key"):
        raise LookupError(f"no credentials in the environment nor for profile {profile!r}")
    return Credentials(ini.get(profile, "aws_access_key_id"), ini.get(profile, "aws_secret_access_key"), ini.get(profile, "aws_session_token", fallback=None))


def _quoted(s: str, safe: str = "") -> str:
    return urllib.parse.quote(s, safe="-_.~" + safe)


def canonical_request(method: str, url: str, headers: dict[str, str], payload_hash: str) -> tuple[str, str]:
    """(request, signed header names)."""
    u = urllib.parse.urlsplit(url)
    query = "&".join(f"{_quoted(k)}={_quoted(v)}" for k, v in sorted(urllib.parse.parse_qsl(u.query, keep_blank_values=True)))
    low = {k.lower(): " ".join(v.split()) for k, v in headers.items()}
    names = ";".join(sorted(low))
    lines = "".join(f"{k}:{low[k]}\n" for k in sorted(low))
    return "\n".join([method, _quoted(urllib.parse.unquote(u.path) or "/", "/"), query, lines, names, payload_hash]), names


def sign(method: str, url: str, headers: dict[str, str], payload: bytes, creds: Credentials, region: str, service: str = "s3", now: datetime.datetime | None = None) -> dict[str, str]:
    """headers with host, date, payload hash (s3), token and Authorization; an Authorization given already is refused."""
    if any(k.lower() == "authorization" for k in headers):
        raise ValueError("request has an Authorization header already")
    now = now or datetime.datetime.now(datetime.UTC)
    stamp, day = now.strftime("%Y%m%dT%H%M%SZ"), now.strftime("%Y%m%d")
    body = hashlib.sha256(payload).hexdigest()
    out = dict(headers) | {"host": urllib.parse.urlsplit(url).netloc, "x-amz-date": stamp}
    if service == "s3":
        out["x-amz-content-sha256"] = body
    if creds.token:
        out["x-amz-security-token"] = creds.token
    request, names = canonical_request(method, url, out, body)
    scope = f"{day}/{region}/{service}/aws4_request"
    text = "\n".join(["AWS4-HMAC-SHA256", stamp, scope, hashlib.sha256(request.encode()).hexdigest()])
    key = ("AWS4" + creds.secret).encode()
    for part in (day, region, service, "aws4_request"):
        key = hmac.new(key, part.encode(), hashlib.sha256).digest()
    signature = hmac.new(key, text.encode(), hashlib.sha256).hexdigest()
    return out | {"Authorization": f"AWS4-HMAC-SHA256 Credential={creds.key}/{scope}, SignedHeaders={names}, Signature={signature}"}
