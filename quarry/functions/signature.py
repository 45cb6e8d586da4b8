"""Ed25519 in plain Python, where no crypto module is at hand, and the `verified` column made with it."""

from __future__ import annotations

import base64
import hashlib

from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, StructField, StructType

P = 2**255 - 19
ORDER = 2**252 + 27742317777372353535851937790883648493
D = -121665 * pow(121666, -1, P) % P
BASE_Y = 4 * pow(5, -1, P) % P


def _x(y: int, sign: int) -> int | None:
    if y >= P:
        return None
    square = (y * y - 1) * pow(D * y * y + 1, -1, P) % P
    x = pow(square, (P + 3) // 8, P)
    if (x * x - square) % P:
        x = x * pow(2, (P - 1) // 4, P) % P
    if (x * x - square) % P or (x == 0 and sign):
        return None
    return P - x if x % 2 != sign else x


def _add(p, q):
    a, b = (p[1] - p[0]) * (q[1] - q[0]) % P, (p[1] + p[0]) * (q[1] + q[0]) % P
    c, d = 2 * p[3] * q[3] * D % P, 2 * p[2] * q[2] % P
    e, f, g, h = b - a, d - c, d + c, b + a
    return e * f % P, g * h % P, f * g % P, e * h % P


def _times(k: int, p):
    out = (0, 1, 1, 0)
    while k:
        if k & 1:
            out = _add(out, p)
        p, k = _add(p, p), k >> 1
    return out


def _point(raw: bytes):
    y = int.from_bytes(raw, "little")
    x = _x(y & (2**255 - 1), y >> 255)
    return None if x is None else (x, y & (2**255 - 1), 1, x * (y & (2**255 - 1)) % P)


BASE = (_x(BASE_Y, 0), BASE_Y, 1, _x(BASE_Y, 0) * BASE_Y % P)


def valid(public: bytes, message: bytes, signature: bytes) -> bool:
    """Whether the signature of the message is the key's."""
    if len(public) != 32 or len(signature) != 64:
        return False
    a, r = _point(public), _point(signature[:32])
    s = int.from_bytes(signature[32:], "little")
    if a is None or r is None or s >= ORDER:
        return False
    k = int.from_bytes(hashlib.sha512(signature[:32] + public + message).digest(), "little") % ORDER
    left, right = _times(s, BASE), _add(r, _times(k, a))
    return (left[0] * right[2] - right[0] * left[2]) % P == 0 and (left[1] * right[2] - right[1] * left[2]) % P == 0


def any_valid(fingerprint: str, signatures: list[str], keys: dict[str, str]) -> bool:
    """Whether one of the name:base64 signatures is valid under the key of its name."""
    for text in signatures or ():
        name, _, body = text.partition(":")
        if name in keys:
            try:
                if valid(base64.b64decode(keys[name], validate=True), fingerprint.encode(), base64.b64decode(body, validate=True)):
                    return True
            except ValueError:
                continue
    return False


def sign(secret: bytes, message: bytes) -> tuple[bytes, bytes]:
    """The public key of a 32-byte secret, and its signature of the message; for made-up rows, not for real secrets."""

    def packed(p) -> bytes:
        inverse = pow(p[2], -1, P)
        x, y = p[0] * inverse % P, p[1] * inverse % P
        return (y | (x & 1) << 255).to_bytes(32, "little")

    h = hashlib.sha512(secret).digest()
    a = int.from_bytes(h[:32], "little") & ((1 << 254) - 8) | (1 << 254)
    public = packed(_times(a, BASE))
    r = int.from_bytes(hashlib.sha512(h[32:] + message).digest(), "little") % ORDER
    point = packed(_times(r, BASE))
    k = int.from_bytes(hashlib.sha512(point + public + message).digest(), "little") % ORDER
    return public, point + ((r + k * a) % ORDER).to_bytes(32, "little")


def verified(rows: DataFrame, keys: dict[str, str]) -> DataFrame:
    """rows (fingerprint, sigs) with `verified`: whether one of the signatures is a trusted key's. keys: name to base64, the configured ones.

    A null fingerprint or list is not verified.
    """
    import pyarrow as pa

    schema = StructType([*rows.schema.fields, StructField("verified", BooleanType())])

    def run(batches):
        for b in batches:
            got = [f is not None and any_valid(f, s or [], keys) for f, s in zip(b.column("fingerprint").to_pylist(), b.column("sigs").to_pylist(), strict=True)]
            yield pa.record_batch([*b.columns, pa.array(got, pa.bool_())], [*b.schema.names, "verified"])

    return rows.mapInArrow(run, schema)
