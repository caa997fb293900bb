"""HMAC-SHA256 and HS256 tokens as columns."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days of validity by plan length.
EXPIRY_DAYS = {"trial_14": 14, "trial_30": 30, "quarterly": 90, "annual": 365, "three_year": 1095}


def b64url(data: bytes) -> str:
    """Base64 for URLs, without padding."""
    return base64.urlsafe_b64encode(data).rstrip(b"=").decode()


def _unb64url(text: str) -> bytes:
    return base64.urlsafe_b64decode(text + "=" * (-len(text) % 4))


def mac(data: bytes, key: bytes) -> str:
    return b64url(hmac.new(key, data, hashlib.sha256).digest())


def hmac_sha256(data: Column, key: bytes) -> Column:
    """HMAC-SHA256 of a binary column, in base64 for URLs."""

    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else mac(v, key) for v in values.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(data)


def mint(claims: dict, key: bytes) -> str:
    """An HS256 token."""
    head = b64url(json.dumps({"typ": "JWT", "alg": "HS256"}, separators=(",", ":")).encode())
    body = b64url(json.dumps(claims, separators=(",", ":")).encode())
    return f"{head}.{body}.{mac(f'{head}.{body}'.encode(), key)}"


def verdict(token: str | None, key: bytes, now: int) -> str:
    """valid, malformed, algorithm, signature or expired."""
    try:
        head, body, signature = (token or "").split(".")
        kind, claims = json.loads(_unb64url(head)), json.loads(_unb64url(body))
    except ValueError:
        return "malformed"
    if not isinstance(kind, dict) or not isinstance(claims, dict):
        return "malformed"
    if kind.get("alg") != "HS256":
        return "algorithm"
    if not hmac.compare_digest(mac(f"{head}.{body}".encode(), key), signature):
        return "signature"
    return "valid" if isinstance(claims.get("exp"), (int, float)) and claims["exp"] > now else "expired"


def minted(claims: Column, key: bytes) -> Column:
    """Tokens of JSON claims; null for what is no JSON object."""

    def one(value: str | None) -> str | None:
        try:
            found = json.loads(value or "")
        except ValueError:
            return None
        return mint(found, key) if isinstance(found, dict) else None

    def run(values: pa.Array) -> pa.Array:
        return pa.array([one(v) for v in values.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(claims)


def token_verdict(token: Column, key: bytes, now: int) -> Column:
    def run(values: pa.Array) -> pa.Array:
        return pa.array([verdict(v, key, now) for v in values.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(token)


def license_claims(subject: Column, issued: Column, plan: Column, **limits: int) -> Column:
    """Claims of a licence as JSON: subject, issue and expiry in epoch seconds, and limits. The plan names its length."""
    days = F.lit(None).cast("bigint")
    for name, n in EXPIRY_DAYS.items():
        days = F.when(plan == name, F.lit(n).cast("bigint")).otherwise(days)
    return F.to_json(F.struct(subject.alias("sub"), issued.alias("iat"), (issued + days * 86_400).alias("exp"), plan.alias("plan"), *(F.lit(v).alias(k) for k, v in limits.items())))
